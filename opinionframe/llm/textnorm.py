"""Normal forms of carelessly typed text, shared by the operators of this subpackage (driver and workers)."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latin spellings of Cyrillic letters, the two keyboards' letters key by key, and letters that look alike.
LATIN = dict(zip("абвгдезийклмнопрстуфхцыэ", "a b v g d e z i y k l m n o p r s t u f kh ts y e".split(), strict=True)) | {
    "ё": "e", "ж": "zh", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya",
}
KEYS = dict(zip("qwertyuiop[]asdfghjkl;'zxcvbnm,.`", "йцукенгшщзхъфывапролджэячсмитьбюё", strict=True))
ALIKE = dict(zip("aceopxykmtbh", "асеорхукмтвн", strict=True))
_LATIN, _KEYS, _ALIKE = (str.maketrans(d) for d in (LATIN, KEYS, ALIKE))
_CYRILLIC = re.compile("[а-яё]")
_WORD = re.compile(r"[^\W\d_]+")


def to_latin(text: str) -> str:
    return text.translate(_LATIN)


def readings(text: str) -> list[str]:
    """The ways ``text`` may have been meant, in lower case: look-alikes undone, or as Latin and as the wrong keyboard."""
    low = unicodedata.normalize("NFKC", text).lower()
    if _CYRILLIC.search(low):
        return [low.translate(_ALIKE)]
    return [low, low.translate(_KEYS)] if re.search("[a-z]", low) else [low]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


def edit_distance(a: str, b: str, most: int = 99) -> int:
    """Edits (insert, delete, replace, swap of neighbours) that turn a into b; more than ``most`` comes out as most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    start, ends = 0, min(len(a), len(b))
    while start < ends and a[start] == b[start]:  # equal beginnings and ends need no edits
        start += 1
    end = 0
    while end < ends - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def hash64(text: str) -> int:
    """A signed 64-bit hash that is the same on every worker."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


RARITY_BUCKETS = 1 << 16


def rarity_table(tokens: DataFrame, col: str, buckets: int = RARITY_BUCKETS) -> np.ndarray:
    """How often tokens occur, by hash bucket: an array of a fixed size whatever the data hold (256 KB).

    It only orders tokens from rare to frequent. Any fixed order gives the same result of a prefix filter; a good one
    makes it faster. ``col`` holds 64-bit hashes.
    """
    counts = tokens.groupBy(F.pmod(F.col(col), F.lit(buckets)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    table = np.zeros(buckets, dtype=np.int64)
    for b, n in counts.collect():  # at most ``buckets`` rows
        table[b] = n
    return np.minimum(table, np.iinfo(np.int32).max).astype(np.int32)


def blank(col: Column) -> Column:
    """True where a typed value is no value: null, blank, ``none`` or ``nan`` in any case."""
    return F.coalesce(F.lower(F.regexp_replace(col, r"^[\s\p{Z}\x{FEFF}\x{200B}]+|[\s\p{Z}\x{FEFF}\x{200B}]+$", "")).isin("", "none", "nan"), F.lit(True))
