"""Tokenising whole texts inside tasks, by chunks that encode alone exactly as they do in their text.

A text is cut only where no rule of the tokenizer can see across: at blanks, and around punctuation where all characters
are proven harmless. Chunks recur, so each is looked up in a bounded memory and only new ones reach the tokenizer. The ids of
a text are the ids of its chunks, one after the other.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a task remembers, and characters of text that it looks at together; both bound its memory.
MEMO_CHUNKS = 700_000
RUN_CHARS = 4_000_000
#: Characters of the remembered chunks of texts on average, at most; chunks longer than LONG_CHUNK are not remembered.
CHUNK_CHARS = 12
LONG_CHUNK = 1_000


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """A tokenizers.Tokenizer, once for each worker; truncation and padding are off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def encode_all(path: str, chunks: list[str]) -> list[list[int]]:
    return [e.ids for e in load_tokenizer(path).encode_batch_fast(chunks, add_special_tokens=False)]


#: The characters that the tokenizers' patterns take as blanks.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"
_BLANK_RUN = re.compile(f"[{BLANKS}]+")
#: Those that only Python's split() takes as blanks.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Anything but characters that composition leaves alone, that lower-case one by one, and that are letters, digits or
#: punctuation in all versions of Unicode alike: Latin, Cyrillic, common punctuation.
_UNPROVEN = re.compile("[^\x01-\x1b\x20-įı-˿Ѐ-҂Ҋ-ԓ‐-‧‰-‾€]")
#: A full stop or comma next to other punctuation, with which it would be one pre-token.
_RUN = re.compile(r"[.,](?:(?![^\W_]|\s|$)|(?<=[^\w\s][.,])|(?<=_[.,]))")
#: The same, or behind a blank, which some rules join to it.
_RUN_OR_BLANK = re.compile(r"[.,](?:(?![^\W_]|\s|$)|(?<=[\W_][.,]))")


def word_chunks(text: str) -> tuple[bool, list[str]]:
    """For lower-casing tokenizers that drop white space: whether chunks are final, and what stands between blanks.

    Neither composition, lower-casing of single characters, special strings nor patterns reach across a blank. In texts of
    proven characters only, stops and commas that stand alone are cut off as well and words are lower-cased, by plain string
    operations, and chunks are final; other chunks are taken apart once each (``parted``).
    """
    if not text.isascii() and _UNPROVEN.search(text) or any(c in text for c in _SEPARATORS):
        return False, [x for x in _BLANK_RUN.split(text) if x]
    text = text.lower()
    if _RUN.search(text) is None:
        text = text.replace(".", " . ").replace(",", " , ")
    return True, text.split()


_BYTE_CHUNK = re.compile(f"[{BLANKS}]+(?![^{BLANKS}])| ?[^{BLANKS}]+|[{BLANKS}]")
_OTHER_BLANKS = BLANKS.replace(" ", "").replace("\n", "")


@lru_cache(maxsize=4)
def special_strings(path: str) -> re.Pattern | None:
    """A pattern of the strings that a tokenizer takes out of a text before all else, the longest first."""
    found = sorted((t.content for t in load_tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile(f"({'|'.join(map(re.escape, found))})") if found else None


def _byte_cut(text: str, specials: re.Pattern | None) -> str | None:
    """A text with a mark between its chunks, which are final, where plain string operations do; None for other texts."""
    if (
        not text.isascii() and _UNPROVEN.search(text)
        or "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or "\x01" in text
        or text[-1:] == " " or text[-2:] == "\n\n" or any(b in text for b in _OTHER_BLANKS)
        or specials is not None and specials.search(text)
    ):
        return None
    cut = text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01")
    if _RUN_OR_BLANK.search(text) is None:
        cut = cut.replace(".", "\x01.\x01").replace(",", "\x01,\x01")
    return cut


def byte_chunks(text: str, specials: re.Pattern | None) -> tuple[bool, list[str]]:
    """For byte-level tokenizers, where one space goes with the word after it: whether chunks are final, and the chunks.

    Of a run of blanks before a word the last one stands alone, or goes with the word if it is a space; the rest are one
    pre-token. Plain string operations do for texts of proven characters whose blanks are single spaces and one or two line
    ends; a pattern cuts the others at blanks. What stands between special strings is a text of its own.
    """
    cut = _byte_cut(text, specials)
    if cut is not None:
        return True, cut.split("\x01")
    if specials is None or not specials.search(text):
        return False, _BYTE_CHUNK.findall(text)
    return False, [c for k, x in enumerate(specials.split(text)) for c in ([x] if k % 2 else _BYTE_CHUNK.findall(x))]


def in_runs(texts: Iterable[str | None], limit: int = RUN_CHARS) -> Iterator[list[str]]:
    """Consecutive texts, null as empty, of some ``limit`` characters together; a longer text is a run of its own."""
    run: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


class _Known(dict):
    """A dictionary that notes what it lacks, so that one look at each chunk does."""

    def __init__(self) -> None:
        self.lacking: list[str] = []

    def __missing__(self, chunk: str) -> None:
        self.lacking.append(chunk)


class ChunkMemo:
    """Chunk to value, for a whole worker, of bounded size in two generations: a full one becomes the old one, whose entries
    come back on use. With ``most_chars``, for chunks of any length, their characters are counted as well."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = MEMO_CHUNKS, most_chars: int | None = None) -> None:
        self.encode, self.limit, self.most_chars = encode, limit, most_chars
        self.young, self.old = _Known(), _Known()
        self.chars = 0

    def _values_of(self, missing: list[str]) -> list:
        """The values of distinct chunks that the young generation lacks, which then has them, but for long ones."""
        found = list(map(self.old.get, missing))
        new = [k for k, v in enumerate(found) if v is None]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for k, value in zip(some, self.encode([missing[k] for k in some]), strict=True):
                found[k] = value
        kept, chars = dict(zip(missing, found, strict=True)), 0
        if self.most_chars is not None:
            kept = {c: v for c, v in kept.items() if len(c) <= LONG_CHUNK}
            chars = sum(map(len, kept))
        if len(self.young) + len(kept) > self.limit or self.most_chars is not None and self.chars + chars > self.most_chars:
            self.old, self.young, self.chars = self.young, _Known(), 0
        self.young.update(kept)
        self.chars += chars
        return found

    def values(self, lists: Sequence[Sequence[str]]) -> list[list]:
        """The values of every chunk of ``lists``."""
        known = self.young
        found = [list(map(known.__getitem__, chunks)) for chunks in lists]
        if not known.lacking:
            return found
        missing = list(set(known.lacking))
        known.lacking.clear()
        value = dict(zip(missing, self._values_of(missing), strict=True))
        for values, chunks in zip(found, lists, strict=True):
            for at in [k for k, v in enumerate(values) if v is None]:
                values[at] = value[chunks[at]]
        return found

    def of_distinct(self, chunks: list[str]) -> list:
        """The values of chunks that differ from each other."""
        found = list(map(self.young.get, chunks))
        lacking = [k for k, v in enumerate(found) if v is None]
        for k, value in zip(lacking, self._values_of([chunks[k] for k in lacking]), strict=True):
            found[k] = value
        return found


#: A word of proven letters with ASCII punctuation behind it: two pre-tokens for the patterns of both kinds of tokenizers.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
WORD_AND_MARKS = re.compile(rf"( ?[{_LETTERS}]+)([!-/:-@\[-`{{-~]*)")


def parted(chunks: list[str], lower: bool) -> list[tuple[str, ...]]:
    """The parts of each chunk that encode alone: a word and the punctuation behind it, where it has that form."""
    matches = map(WORD_AND_MARKS.fullmatch, chunks)
    pairs = [(c,) if m is None else (m[1].lower() if lower else m[1], m[2]) for c, m in zip(chunks, matches, strict=True)]
    return [(p[0],) if p[-1] == "" else p for p in pairs]


def encode_words(path: str, words: list[str], glue: str, width: int) -> list[bytes] | None:
    """Ids of words of letters only, which are one pre-token each, from one call on all of them; None if they were not.

    One call is a third cheaper than one for each. The glue between the words must be dropped by the tokenizer, or be empty
    as the words begin with a space, or be a pre-token of its own (a line end).
    """
    found = load_tokenizer(path).encode(glue.join(words), add_special_tokens=False)
    number = np.array(found.word_ids, np.int64)
    first = np.flatnonzero(np.diff(number, prepend=-1))
    step = 2 if glue == "\n" else 1
    if len(first) != step * len(words) - step + 1:
        return None
    flat = np.array(found.ids, f"<u{width}").tobytes()
    ends = [*(width * first[1:]).tolist(), len(flat)][::step]
    return [flat[a:b] for a, b in zip((width * first[::step]).tolist(), ends, strict=True)]


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as itself, the rest from 256 up."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


#: Words that the model takes together; its queue grows with them.
_WORDS_TOGETHER = 200


@lru_cache(maxsize=4)
def _model_alone(path: str):
    """A tokenizer that is the model of a byte-level tokenizer alone, what each byte of a word is to it, and the ids of two
    letters that it never merges, written for a line end and a carriage return; None for other tokenizers.

    A word of proven letters, and the punctuation behind it, is one pre-token each that nothing but the model changes. Words
    with a letter between them that is in no merge encode together as they do alone.
    """
    from tokenizers import Tokenizer

    found = load_tokenizer(path)
    rules = json.loads(found.to_str())
    cuts, model, specials = rules["pre_tokenizer"] or {}, rules["model"], [t.content for t in found.get_added_tokens_decoder().values()]
    if rules["normalizer"] or model["type"] != "BPE" or cuts.get("type") != "ByteLevel" or cuts["add_prefix_space"] or not cuts["use_regex"] or any(map(WORD_AND_MARKS.fullmatch, specials)):
        return None
    vocab, letters = model["vocab"], {b: letter for letter, b in byte_letters().items()}
    joined = set().union(*(t for t in vocab if len(t) > 1))
    apart = [b for b, letter in letters.items() if letter not in joined]
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) or not vocab.keys() >= set(letters.values()) or len(apart) < 2:
        return None
    table = np.array([ord(letters[b]) for b in range(256)], "<u4")
    between, inside = (letters[b] for b in apart[:2])
    table[[10, 13]] = ord(between), ord(inside)
    return Tokenizer(found.model), table, vocab[between], vocab[inside]


def model_words(path: str, words: list[str], width: int) -> list[bytes] | None:
    """Ids of words of proven letters, a space before them or none, and of a carriage return between them and punctuation
    behind them or neither, from the model alone; None if the tokenizer takes more than that.

    Many words at once take a third as long as one by one, and a quarter of all that ``encode`` keeps of a text.
    """
    alone = _model_alone(path)
    if alone is None:
        return None
    model, table, between, inside = alone
    texts = ["\n".join([*words[at : at + _WORDS_TOGETHER], ""]) for at in range(0, len(words), _WORDS_TOGETHER)]
    texts = [table[np.frombuffer(t.encode(), np.uint8)].tobytes().decode("utf-32-le") for t in texts]
    flat = np.concatenate([np.zeros(0, "<u4"), *(np.array(e.ids, "<u4") for e in model.encode_batch_fast(texts, add_special_tokens=False))])
    flat = flat[flat != inside]
    ends = np.flatnonzero(flat == between)
    raw = np.delete(flat, ends).astype(f"<u{width}").tobytes()
    ends = (width * (ends - np.arange(len(ends)))).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _encoder(path: str, spaced: bool, width: int) -> Callable[[list[str]], list[bytes]]:
    def each(chunks: list[str]) -> list[bytes]:
        return [np.array(ids, f"<u{width}").tobytes() for ids in encode_all(path, chunks)]

    def encode(chunks: list[str]) -> list[bytes]:
        known: dict[str, bytes] = {}
        other = chunks
        if spaced and _model_alone(path):
            matches = list(map(WORD_AND_MARKS.fullmatch, chunks))
            words = [c if m.end(1) == len(c) else f"{m[1]}\r{m[2]}" for c, m in zip(chunks, matches, strict=True) if m]
            ids = model_words(path, words, width)
            if len(words) == len(chunks):
                return ids
            known.update(zip([c for c, m in zip(chunks, matches, strict=True) if m], ids, strict=True))
            other = [c for c, m in zip(chunks, matches, strict=True) if not m]
        alone = [c for c in other if c.isalpha()]
        kinds = [("\n", alone), ("", [c for c in other if c[:1] == " " and c[1:].isalpha()])] if spaced else [(" ", alone)]
        for glue, words in kinds:
            for at in range(0, len(words), 2_000):
                some = words[at : at + 2_000]
                known.update(zip(some, encode_words(path, some, glue, width) or each(some), strict=True))
        rest = [c for c in chunks if c not in known]
        known.update(zip(rest, each(rest), strict=True))
        return [known[c] for c in chunks]

    return encode


class TextMemo:
    """Values of the chunks of whole texts. Final chunks, and the parts of the others, share one memory; those others have a
    smaller one, as their parts are remembered."""

    def __init__(self, encode: Callable[[list[str]], list], add: Callable[[list], object], lower: bool, limit: int = MEMO_CHUNKS) -> None:
        self.parts = ChunkMemo(encode, limit, CHUNK_CHARS * limit)
        self.chunks = ChunkMemo(lambda chunks: [add(v) for v in self.parts.values(parted(chunks, lower))], limit // 4, CHUNK_CHARS * limit // 4)

    def values(self, texts: list[tuple[bool, list[str]]]) -> list[list]:
        ready, others = [[chunks for final, chunks in texts if final is kind] for kind in (True, False)]
        found = {True: iter(self.parts.values(ready)), False: iter(self.chunks.values(others))}
        return [next(found[final]) for final, _ in texts]


@lru_cache(maxsize=8)
def _memo(path: str, spaced: bool, width: int) -> TextMemo:
    return TextMemo(_encoder(path, spaced, width), b"".join, not spaced)


@contextmanager
def _without_cycle_search() -> Iterator[None]:
    """Nothing here refers to itself, and looking through all that is remembered for it takes a fifth of the time."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def word_ids(path: str, texts: list[str], width: int = 4) -> list[bytes]:
    """Ids of each text as little-endian unsigned integers of ``width`` bytes, for a tokenizer that drops white space."""
    with _without_cycle_search():
        return [b"".join(x) for x in _memo(path, False, width).values([word_chunks(t) for t in texts])]


def _joined_ids(memo: ChunkMemo, cuts: list[str], width: int) -> list[bytes]:
    """Ids of texts with marks between their final chunks. Each distinct chunk of all these texts is looked up once; their
    ids are then put together by place."""
    lists = pc.split_pattern(pa.array(cuts, pa.large_string()), "\x01")
    chunks = lists.flatten().dictionary_encode()
    values = memo.of_distinct(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
    kind = f"<u{width}"
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // width
    starts, at = np.cumsum(sizes) - sizes, chunks.indices.to_numpy()
    sizes = sizes[at]
    ends = np.cumsum(sizes)
    places = np.repeat(starts[at] - ends + sizes, sizes)
    places += np.arange(len(places))
    raw = np.frombuffer(b"".join(values), kind)[places].tobytes()
    of_texts = (width * np.append(0, ends)[lists.offsets.to_numpy()]).tolist()
    return [raw[a:b] for a, b in zip(of_texts, of_texts[1:])]


def byte_ids(path: str, texts: list[str], width: int = 4) -> list[bytes]:
    """The same for a byte-level tokenizer."""
    return remembered_ids(_memo(path, True, width), special_strings(path), texts, width)


def remembered_ids(memo: TextMemo, specials: re.Pattern | None, texts: list[str], width: int) -> list[bytes]:
    """Ids of each text by a memory that has byte-level chunks as unsigned integers of ``width`` bytes."""
    with _without_cycle_search():
        cuts = [_byte_cut(t, specials) for t in texts]
        plain = iter(_joined_ids(memo.parts, [c for c in cuts if c is not None], width))
        others = iter(memo.values([byte_chunks(t, specials) for t, c in zip(texts, cuts, strict=True) if c is None]))
        return [b"".join(next(others)) if c is None else next(plain) for c in cuts]


def id_width(path: str) -> int:
    """Bytes that hold any id of a tokenizer: 2 or 4."""
    return 2 if max(load_tokenizer(path).get_vocab(with_added_tokens=True).values()) <= 0xFFFF else 4
