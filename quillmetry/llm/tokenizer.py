"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8), by Spark higher-order functions.

A text is parted into words by the tokenizer's pattern. Of each distinct word a fold over its bytes merges, one at a
time, the leftmost pair of pieces with the lowest rank in a literal rank map; no Python runs on executors. The rank map
is a literal array of hash buckets (a Spark map literal is searched from end to end), bounded by the vocabulary file.

The ids of the `hot` most frequent distinct words, a bounded number, are kept in a second bucketed literal; every other
word is folded where it stands. The result never depends on which words are hot. The corpus needs no shuffle of texts.

Defined results: an empty text and a null text both have the empty list of ids. Texts are encoded whole; strings of
special tokens in a text are ordinary text. Repeated rows are encoded each; extra columns pass through.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary is; a parameter of every function here.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern of the public tokenizers of this kind, with white space as Unicode has it.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PAIR_BUCKETS = 16384
WORD_BUCKETS = 8192
HOT_WORDS = 16384
#: Longer words are never hot, so the hot table has a size bound: HOT_WORDS words of HOT_BYTES bytes.
HOT_BYTES = 64
_NONE = 1 << 30


@lru_cache(maxsize=4)
def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def _merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two pieces whose merge makes the token: what merges of lower rank alone leave of it."""
    parts, top = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], _NONE), i) for i in range(len(parts) - 1))
        if rank >= top:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None


@lru_cache(maxsize=4)
def _pair_text(path: str) -> str:
    """Buckets of merges, joined by commas: each entry is ;, the two pieces' ids as 9 hex digits, the merged id as 5."""
    ranks = read_ranks(path)
    buckets = [""] * PAIR_BUCKETS
    for token, merged in ranks.items():
        if len(token) > 1 and (pair := _merge_of(token, ranks)):
            buckets[(pair[0] * 40503 + pair[1]) % PAIR_BUCKETS] += f";{pair[0] << 17 | pair[1]:09X}{merged:05X}"
    return ",".join(buckets)


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _byte_ids(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of the single bytes of a word."""
    single = F.array(*[F.lit(ranks[bytes([i])]) for i in range(256)])
    digits = F.lit("0123456789ABCDEF")

    def of_hex(h: Column) -> Column:
        nibble = lambda i: F.instr(digits, h.substr(i, F.lit(1))) - 1
        return F.transform(F.sequence(F.lit(1), (F.length(h) / 2).cast("int")), lambda i: F.element_at(single, nibble(i * 2 - 1) * 16 + nibble(i * 2) + 1))

    return _let(F.hex(F.encode(word, "UTF-8")), of_hex)


def _rank(a: Column, b: Column, pairs: Column) -> Column:
    """Id of the piece that a and b make, _NONE if there is none."""
    a, b = a.cast("long"), b.cast("long")
    bucket = F.element_at(pairs, ((a * 40503 + b) % PAIR_BUCKETS + 1).cast("int"))
    key = F.concat(F.lit(";"), F.lpad(F.hex(F.shiftleft(a, 17) + b), 9, "0"))
    return _let(F.struct(bucket.alias("text"), F.instr(bucket, key).alias("at")), lambda x: F.when(x["at"] == 0, F.lit(_NONE)).otherwise(F.conv(x["text"].substr(x["at"] + 10, F.lit(5)), 16, 10).cast("int")))


def word_ids(word: Column, path: str = RANKS) -> Column:
    """Ids of one word: the ids of its bytes, folded by the ranked merges; a fold of n bytes needs n - 1 merges at most."""
    pairs = F.split(F.lit(_pair_text(path)), ",")
    state = lambda ids, done: F.struct(ids.alias("ids"), done.alias("done"))

    def best(ids: Column) -> Column:
        """Rank and place of the leftmost pair of lowest rank."""
        none = F.struct(F.lit(_NONE).alias("rank"), F.lit(0).alias("at"))
        better = lambda acc, j: _let(_rank(F.element_at(ids, j), F.element_at(ids, j + 1), pairs), lambda r: F.when(r < acc["rank"], F.struct(r.alias("rank"), j.alias("at"))).otherwise(acc))
        return F.aggregate(F.sequence(F.lit(1), F.size(ids) - 1), none, better)

    def step(s: Column, _: Column) -> Column:
        ids = s["ids"]
        merged = lambda b: F.concat(F.slice(ids, F.lit(1), b["at"] - 1), F.array(b["rank"]), F.slice(ids, b["at"] + 2, F.greatest(F.size(ids) - b["at"] - 1, F.lit(0))))
        move = _let(best(ids), lambda b: F.when(b["rank"] == _NONE, state(ids, F.lit(True))).otherwise(state(merged(b), F.lit(False))))
        return F.when(s["done"] | (F.size(ids) < 2), state(ids, F.lit(True))).otherwise(move)

    return _let(_byte_ids(word, read_ranks(path)), lambda ids: F.aggregate(ids, state(ids, F.lit(False)), step, lambda s: s["ids"]))


def words(text: Column) -> Column:
    """The words of a text by the tokenizer's pattern; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def hot_words(documents: DataFrame, text: str, n: int = HOT_WORDS) -> DataFrame:
    """The n most frequent distinct words of the corpus, of HOT_BYTES bytes at most."""
    seen = documents.select(F.explode(words(F.col(text))).alias("word")).filter(F.octet_length("word") <= HOT_BYTES)
    return seen.groupBy("word").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "word").limit(n).select("word")


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(WORD_BUCKETS))


def encode(documents: DataFrame, text: str, ids: str = "ids", path: str = RANKS, hot: int = HOT_WORDS) -> DataFrame:
    """Add a column with the ids of each text. One bounded collect: the ids of the hot words.

    The literals would fill the plan texts that the driver keeps, so those are cut where the session sets no length.
    """
    conf = documents.sparkSession.conf
    if int(conf.get("spark.sql.maxPlanStringLength", "2147483632")) > 1 << 24:
        conf.set("spark.sql.maxPlanStringLength", str(1 << 16))
    known = hot_words(documents, text, hot)
    known = known.repartition(max(1, documents.sparkSession.sparkContext.defaultParallelism)) if hot > 4096 else known
    buckets: list[dict[str, list[int]]] = [{} for _ in range(WORD_BUCKETS)]
    for row in known.select("word", _bucket(F.col("word")).alias("b"), word_ids(F.col("word"), path).alias("ids")).toArrow().to_pylist():
        buckets[row["b"]][row["word"]] = row["ids"]
    table = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,array<int>>>")
    of_word = lambda w: F.coalesce(F.try_element_at(F.element_at(table, _bucket(w) + 1), w), word_ids(w, path))
    return documents.withColumn(ids, F.flatten(F.transform(words(F.col(text)), of_word)))


def decode(ids: Column, path: str = RANKS) -> Column:
    """The text of a list of ids: the pieces' bytes one after another."""
    ranks = read_ranks(path)
    by_id = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token.hex()
    pieces = F.split(F.lit(",".join(by_id)), ",")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, i + 1)), "")), "UTF-8")
