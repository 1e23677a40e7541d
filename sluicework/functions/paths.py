"""POSIX paths as column expressions: segments, resolution without links, safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework.functions.text import strip



def segments(path: Column) -> Column:
    """The segments of a path, without empty ones and ``.``; ``..`` stays. Null has none."""
    return F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: (s != "") & (s != "."))


def is_absolute(path: Column) -> Column:
    return F.coalesce(F.startswith(path, F.lit("/")), F.lit(False))


def folded(parts: Column) -> Column:
    """Segments with every ``..`` carried out: a stack from which it takes the last one; above the root it does nothing."""
    empty = F.array().cast("array<string>")
    return F.aggregate(parts, empty, lambda stack, s: F.when(s == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(s))))


def resolve(root: str | Column, path: Column) -> Column:
    """The absolute path that ``path`` means below ``root``; an absolute one stands for itself. Links are not followed."""
    base = segments(F.lit(root) if isinstance(root, str) else root)
    start = F.when(is_absolute(path), F.array().cast("array<string>")).otherwise(base)
    return F.concat(F.lit("/"), F.array_join(folded(F.concat(start, segments(path))), "/"))


def is_under(path: Column, root: str | Column) -> Column:
    """Whether a resolved path is a resolved root or lies below it."""
    top = F.lit(root) if isinstance(root, str) else root
    return (path == top) | F.startswith(path, F.concat(F.rtrim(top, F.lit("/")), F.lit("/")))


def image_path(root: str, csv_dir: str, required: str, value: Column) -> Column:
    """The path of an image: below the root if that lands in the required folder, else below the folder of its CSV file."""
    value = strip(F.coalesce(value, F.lit("")))
    at_root = resolve(root, value)
    return F.when(is_under(at_root, f"{root}/{required}"), at_root).otherwise(resolve(f"{root}/{csv_dir}", value))


def path_rules(root: str, required: str, value: Column, resolved: Column, exists: Column) -> list[tuple[str, Column, Column]]:
    """The rules on an image path, in order; an empty one breaks none. A path breaks at most the first that it fails."""
    value = strip(F.coalesce(value, F.lit("")))
    given = value != ""
    escapes = F.array_contains(segments(value), "..") | ~is_under(resolved, root)
    return [
        ("absolute", F.concat(F.lit("has absolute image_path: "), value), given & is_absolute(value)),
        ("escaping", F.concat(F.lit("has escaping image_path: "), value), given & escapes),
        ("elsewhere", F.concat(F.lit(f"image_path is not under {required}: "), value), given & ~is_under(resolved, f"{root}/{required}")),
        ("missing", F.concat(F.lit("image_path does not exist: "), value), given & ~F.coalesce(exists, F.lit(False))),
    ]
