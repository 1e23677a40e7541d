"""Gates that a model candidate must pass: each that it fails is a rejection with a code and a detail.

Codes, details and limits are fixed values of the contract.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework.functions.text import strip
from sluicework.operators.rules import Rule, all_faults, ladder

CUTOFF = "2026-05-31"
COMMIT, SHA256, DATE = "^[0-9a-f]{40}$", "^[0-9a-f]{64}$", r"^\d{4}-\d{2}-\d{2}$"
GPU = r"(?i)^(?:NVIDIA\s+)?RTX\s+A6000$"
LEAST_VRAM = 48_000


def iso_date(text: Column) -> Column:
    """The date of a canonical YYYY-MM-DD, null if it is not canonical or no day of the calendar (years from 1)."""
    return F.when(text.rlike(DATE) & ~F.startswith(text, F.lit("0000")), F.try_to_date(text, "yyyy-MM-dd"))


def manifest_rules(cutoff: str = CUTOFF) -> list[Rule]:
    """The rules on a manifest's texts, of which the first that fails counts: commit, release_date, remote_api_usage,
    snapshot_sha256, custom_code_hashes (map), preprocessing_metadata (map)."""
    c = F.col
    blank = [("manifest_invalid", f"{n} must be a non-empty string", strip(F.coalesce(c(n), F.lit(""))) == "") for n in ("commit", "release_date", "snapshot_sha256")]
    day = iso_date(c("release_date"))
    hashes = F.map_values("custom_code_hashes")
    return ladder([
        blank[0],
        ("commit_unpinned", "commit must be 40 lowercase hex", ~c("commit").rlike(COMMIT)),
        blank[1],
        ("manifest_invalid", "release_date must be canonical YYYY-MM-DD", ~c("release_date").rlike(DATE)),
        ("manifest_invalid", "release_date must be YYYY-MM-DD", day.isNull()),
        ("cutoff_ineligible", c("release_date"), day > F.lit(cutoff).cast("date")),
        ("remote_api_forbidden", "remote_api_usage must be none", ~c("remote_api_usage").eqNullSafe(F.lit("none"))),
        blank[2],
        ("snapshot_hash_invalid", "snapshot_sha256 must be lowercase hex", ~c("snapshot_sha256").rlike(SHA256)),
        ("custom_code_hash_invalid", "custom code hashes must be SHA-256", F.exists(hashes, lambda h: ~F.coalesce(h.rlike(SHA256), F.lit(False)))),
        ("serialization_evidence_missing", "preprocessing metadata is empty", F.coalesce(F.size("preprocessing_metadata"), F.lit(0)) <= 0),
    ])


def config_rules() -> list[Rule]:
    """The rules on a model's configuration beside its manifest; all that fail count."""
    c = F.col
    return [
        ("adapter_ineligible", "dummy adapter cannot enter diagnostic-48", c("adapter") == "dummy"),
        ("remote_api_forbidden", "local_files_only must be true", ~F.coalesce(c("local_files_only"), F.lit(False))),
        ("snapshot_hash_mismatch", "model config differs", ~c("snapshot_hash").eqNullSafe(c("snapshot_sha256"))),
        ("commit_mismatch", "model config differs", (c("revision") != "") & (c("revision") != c("commit"))),
        ("custom_code_evidence_missing", "trust_remote_code requires verified custom-code hashes", c("trust_remote_code") & (F.coalesce(F.size("custom_code_hashes"), F.lit(0)) <= 0)),
    ]


def hardware_rules() -> list[Rule]:
    """The rules on the machine a candidate ran on; all that fail count, and details give what was found."""
    c = F.col

    def shown(name: str) -> Column:
        return F.coalesce(c(name).cast("string"), F.lit("None"))

    return [
        ("gpu_not_a6000", shown("gpu_name"), ~F.coalesce(strip(c("gpu_name")).rlike(GPU), F.lit(False))),
        ("vram_insufficient", shown("total_vram_mib"), c("total_vram_mib").isNull() | (c("total_vram_mib") < LEAST_VRAM)),
        ("peak_vram_missing", shown("peak_vram_mib"), c("peak_vram_mib").isNull() | (c("peak_vram_mib") < 0)),
    ]


def rejections(cutoff: str = CUTOFF) -> Column:
    """array<struct<code, message>>: a bad manifest alone; else all that the configuration fails; else all that the machine does."""
    manifest, config, machine = all_faults(manifest_rules(cutoff)), all_faults(config_rules()), all_faults(hardware_rules())
    return F.when(F.size(manifest) > 0, manifest).when(F.size(config) > 0, config).otherwise(machine)
