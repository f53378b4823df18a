"""Token counts with a shortcut for words that are one token.

Offline, whole_tokens() proves which vocabulary strings the merges turn into a single token when they stand alone.
A task splits its texts into pre-tokens, counts those of the proven set as one, and runs the merges only on the rest,
each distinct one once in a while (a bounded cache).
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: the pre-token pattern of byte-level BPE vocabularies, as public_tokenizers gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens of the merged kind that a worker remembers.
CACHE = 200_000


@lru_cache(maxsize=2)
def byte_names() -> tuple[str, ...]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return tuple(chr(b) if b in plain else chr(next(other)) for b in range(256))


def mapped(word: str) -> str:
    names = byte_names()
    return "".join(names[b] for b in word.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=2)
def loaded(path: str):
    """(library tokenizer, proven one-token words, pattern, special strings) of a tokenizers .json file."""
    from tokenizers import Tokenizer

    spec = json.loads(open(path, encoding="utf-8").read())
    parts = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and spec["model"].get("type", "BPE") == "BPE" and parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space")
    if not plain or any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", [])):
        raise ValueError(f"{path}: the shortcut is proven for plain byte-level BPE only")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    specials = [x["content"] for x in spec.get("added_tokens", [])]
    return tok, whole_tokens(tok, specials), regex.compile(PATTERN), specials


def whole_tokens(tok, specials: list[str]) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and that the merges keep whole: each is encoded alone."""
    back = {c: b for b, c in enumerate(byte_names())}
    words = []
    for name in tok.get_vocab(with_added_tokens=False):
        try:
            word = bytes(back[c] for c in name).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if word and not any(s in word for s in specials):
            words.append(word)
    split = regex.compile(PATTERN)
    words = [w for w in words if split.findall(w) == [w]]
    coded = tok.encode_batch(words, add_special_tokens=False)
    return frozenset(w for w, e in zip(words, coded, strict=True) if len(e.ids) == 1)


@lru_cache(maxsize=1)
def unsettled() -> str:
    """Code points that Unicode 3.2 had not assigned, as the inside of a character class.

    Pattern engines of other Unicode versions may class them differently; the words round them are left to the
    library. A test proves that the engines agree on all others.
    """
    old = unicodedata.ucd_3_2_0.category
    found = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and old(chr(c)) == "Cn"]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def lone(text: str, i: int) -> bool:
    """Whether a single space between two words stands at i: every engine cuts before it."""
    return 0 < i < len(text) - 1 and text[i] == " " and not text[i - 1].isspace() and not text[i + 1].isspace()


def stretches(text: str, foreign: re.Pattern) -> list[tuple[bool, str]]:
    """text in stretches, and whether each is left to the library: those round foreign characters, from lone space to lone space."""
    out, done = [], 0
    while found := foreign.search(text, done):
        low, high = found.start(), found.end()
        while low > done and not lone(text, low):
            low -= 1
        while high < len(text) and not lone(text, high):
            high += 1
        out += [(False, text[done:low]), (True, text[low:high])]
        done = high
    return [*out, (False, text[done:])]


def count_tokens(texts: list[str | None], path: str, cache: dict[str, int], odd: str = "") -> list[int]:
    """The number of tokens of each text; null counts as empty. odd: see unsettled()."""
    tok, whole, split, specials = loaded(path)
    foreign = re.compile(f"[{odd}]") if odd else None
    at = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def plainly(part: str) -> int:
        words = split.findall(part)
        rest = [w for w in words if w not in whole]
        n = len(words) - len(rest)
        for w in rest:
            c = cache.get(w)
            if c is None:
                c = len(tok.model.tokenize(mapped(w)))
                if len(cache) >= CACHE:
                    cache.clear()
                cache[w] = c
            n += c
        return n

    out = []
    for text in texts:
        n = 0
        parts = [text or ""]
        if at and text and any(s in text for s in specials):
            parts = at.split(text)
            n = len(parts) - 1
        for part in parts:
            if foreign and not part.isascii() and foreign.search(part):
                n += sum(len(tok.encode(x, add_special_tokens=False).ids) if left else plainly(x) for left, x in stretches(part, foreign) if x)
            else:
                n += plainly(part)
        out.append(n)
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row of docs.

    No shuffle: a row is counted where it is read. Null and empty texts have 0 bytes and 0 tokens. Repeated rows
    give repeated results. Other columns of docs are ignored, whatever their names. over_limit: n_tokens > limit.
    """

    odd = unsettled()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            n = [c for i in range(0, batch.num_rows, 256) for c in count_tokens(batch.column(2).slice(i, 256).to_pylist(), path, cache, odd)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["key", "n_bytes", "n_tokens"])

    of = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    out = of.mapInArrow(run, T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
