"""Text functions with Python's semantics, as built-in column expressions."""

from __future__ import annotations

from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: White space as Python's regular expressions see it in Unicode strings.
_SPACE = r"(?U)[\s\x{1c}-\x{1f}]+"
#: All but letters, digits and underscores, white space included; common letters stand first, since they are tried first.
_NOT_WORD = r"[^a-z0-9_\p{L}\p{N}]+"

#: Phrases that give an answer away.
ANSWER_CUES = ("cevap şu", "cevap su", "doğru cevap", "dogru cevap", "nihai cevap")
#: Letters that show Turkish text.
TURKISH_LETTERS = "çğıöşüÇĞİÖŞÜ"


def normalise_space(text: Column) -> Column:
    """Runs of white space become one space, ends are trimmed, null becomes empty."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " "))


def sanitise(text: Column) -> Column:
    """Lower case, anything but letters, digits and underscores becomes a space, spaces collapse."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD, " "))


def tokens(text: Column, least: int = 3) -> Column:
    """Words of the sanitised text with at least `least` characters, repeats kept."""
    return F.filter(F.split(sanitise(text), " "), lambda t: F.length(t) >= least)


#: Ones that a byte can count, and bytes of texts that Python works on at once.
_MOST_IN_BYTE = 255
SLICE_BYTES = 1 << 22


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(low, high) of runs of texts of at most `most` bytes, or one text. A worker then needs memory for a run, whatever a batch holds."""
    ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    low, done = 0, 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, done + most, "right")))
        yield low, high
        low, done = high, int(ends[high - 1])


def by_slices(texts: pa.Array, work, kind: pa.DataType, most: int = SLICE_BYTES) -> pa.Array:
    """`work`, from an array of texts to one of as many values, a slice at a time."""
    return pa.concat_arrays([pa.array([], kind), *(work(texts.slice(low, high - low)) for low, high in slices(texts, most))])


def simhash64(words: Column) -> Column:
    """The 64-bit SimHash of an array of words, repeats counted: of the low 64 bits of the words' MD5 digests, those that more than half have set.

    A batch's different words are digested once, and their bits added up by text. 0 without words.
    """
    return _simhash64(words)


def simhash64_text(text: Column, least: int = 3) -> Column:
    """The SimHash of a text's `tokens`. The sanitised text travels as it is and is cut into words where their bits are counted."""
    return simhash64_clean(sanitise(text), least)


def simhash64_clean(clean: Column, least: int = 3) -> Column:
    """The same for a text that is sanitised already."""
    return _simhash64_text(clean, F.lit(least))


@F.arrow_udf(LongType())
def _simhash64_text(text: pa.Array, least: pa.Array) -> pa.Array:
    fewest = least[0].as_py() if len(least) else 0
    return by_slices(text, lambda part: _hashed(pc.split_pattern(part, " "), fewest), pa.int64())


@F.arrow_udf(LongType())
def _simhash64(words: pa.Array) -> pa.Array:
    return _hashed(words, 0)


def _hashed(words: pa.Array, least: int) -> pa.Array:
    """The SimHash of each list of words, of those with at least `least` characters."""
    lengths = np.array(pc.fill_null(pc.list_value_length(words), 0), np.int64)
    coded = pc.list_flatten(words).dictionary_encode()
    different, codes = coded.dictionary, np.array(coded.indices, np.int64)
    if least:
        long = np.array(pc.greater_equal(pc.utf8_length(different), least), bool)
        kept = long[codes]
        ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(lengths)])]
        lengths, codes, different = np.diff(ends), (np.cumsum(long) - 1)[codes[kept]], different.filter(pa.array(long))
    digests = b"".join([md5(w.encode(), usedforsecurity=False).digest() for w in different.to_numpy(zero_copy_only=False)])
    # the low 64 bits of each digest, lowest first; a bit is a byte, and eight of them are added at once
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 16)[:, :7:-1], axis=1, bitorder="little").view("<u8")
    votes = np.zeros((len(lengths), 64), np.int64)
    held = np.flatnonzero(lengths)
    if len(held):
        starts, blocks = (np.cumsum(lengths) - lengths)[held], -(-lengths[held] // _MOST_IN_BYTE)
        first = np.cumsum(blocks) - blocks
        cuts = np.repeat(starts - first * _MOST_IN_BYTE, blocks) + np.arange(blocks.sum()) * _MOST_IN_BYTE
        sums = np.stack([np.add.reduceat(lane[codes], cuts) for lane in np.ascontiguousarray(bits.T)], axis=1)
        votes[held] = np.add.reduceat(sums.view(np.uint8), first, axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * votes > lengths[:, None], axis=1, bitorder="little")
    return pa.array(set_bits.view("<i8").reshape(-1))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def is_short(text: Column, least: int) -> Column:
    return F.length(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", ""))) < max(1, least)


def is_filled(text: Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(normalise_space(text) != "", F.lit(False)) & text.isNotNull()


def asks(text: Column) -> Column:
    return F.contains(F.coalesce(text, F.lit("")), F.lit("?"))


def gives_answer(text: Column) -> Column:
    clean = sanitise(text)
    return reduce(lambda a, b: a | b, (F.contains(clean, F.lit(c)) for c in ANSWER_CUES))


def is_turkish(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[{TURKISH_LETTERS}]"), F.lit(False))


def lenient_bool(text: Column) -> Column:
    """Truth of a JSON scalar given as text: true, 1, yes, evet, or a number other than 0."""
    word = F.lower(normalise_space(text))
    return F.coalesce(word.isin("true", "1", "yes", "evet") | (word.try_cast("double") != 0), F.lit(False))


def safe_name(text: Column, fallback: str, most: int = 80) -> Column:
    """A file name part: other characters become underscores, then it is cut, then the fallback applies."""
    clean = F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_.-]+", "_"), 1, most)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def short_digest(text: Column, digits: int = 10) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def error_kind(declared: Column, message: Column, name: Column) -> Column:
    """The declared type if there is one, else a JSON error by its message, else the error's class name."""
    return F.coalesce(declared, F.when(F.contains(F.lower(message), F.lit("json")), "judge_json_parse_error"), name)


def base_url(url: Column) -> Column:
    return F.lower(F.rtrim(normalise_space(url), F.lit("/")))


def cleaned_list(values: Column) -> Column:
    """Trimmed, empty ones dropped, first of equal ones kept in place."""
    return F.array_distinct(F.filter(F.transform(values, normalise_space), lambda v: v != ""))


def key_parts(key: Column, prefixed: bool = False) -> tuple[Column, Column]:
    """(question, profile) of a key like 12_FAST, null where it has another form. `prefixed` allows leading underscores."""
    form = r"^_*(\d+)_([A-Za-z0-9]+)$" if prefixed else r"^(\d+)_([A-Za-z0-9]+)$"
    fits = key.rlike(form)
    return F.when(fits, F.regexp_extract(key, form, 1)), F.when(fits, F.regexp_extract(key, form, 2))


def key_parts_or_fail(key: Column) -> tuple[Column, Column]:
    """(question, profile) of a key with or without leading underscores; another form ends the query with an error that names it."""
    fail = F.raise_error(F.concat(F.lit("not a key: "), F.coalesce(key, F.lit("null"))))
    return tuple(F.when(part.isNull(), fail.cast("string")).otherwise(part) for part in key_parts(key, True))


def key_tail(key: Column) -> tuple[Column, Column]:
    """(question, profile) split at the last underscore, where digits stand before it."""
    form = r"^(\d+)_([^_]*)$"
    return F.when(key.rlike(form), F.regexp_extract(key, form, 1)), F.when(key.rlike(form), F.regexp_extract(key, form, 2))
