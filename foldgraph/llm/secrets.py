"""Secret scans: patterns in whole texts, and who owns each candidate across the corpus."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldgraph.llm.common import written

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "owned")
#: The base patterns and their least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: A bare candidate: so long, with letters and digits, and so many bits a character.
BARE, BARE_BITS = r"[A-Za-z0-9+/_=-]{20,}", 3.0

SPAN = "struct<kind:string,start:int,stop:int,digest:string>"
SCANNED = f"n_assign long, n_access long, n_hex long, base_sha256 string, base array<{SPAN}>, bare array<{SPAN}>"


def bits(value: str) -> float:
    """Shannon entropy of a value's characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


class Scanner:
    def __init__(self):
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access = re.compile(ACCESS)
        # A run that is long enough is the whole of a maximal run: the short ones need not be looked at.
        self.hex = re.compile(HEX.replace("+", "{%d,}" % LEAST["hex"]))
        self.bare = re.compile(BARE)

    def base(self, text: str) -> list[tuple[str, int, int, str]]:
        """(kind, start, stop, value) of the base matches, by start, then kind."""
        found = [("assign", m.start(), m.end(), m[2]) for m in self.assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
        if "AKIA" in text:
            found += [("access", m.start(), m.end(), m[0]) for m in self.access.finditer(text) if len(m[0]) >= LEAST["access"]]
        found += [("hex", m.start(), m.end(), m[0]) for m in self.hex.finditer(text)]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))

    def bare_values(self, text: str, taken: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
        """Random-looking tokens that no base span touches."""
        out = []
        for m in self.bare.finditer(text):
            value = m[0]
            if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)) or bits(value) < BARE_BITS:
                continue
            if all(m.end() <= start or m.start() >= stop for _, start, stop, _ in taken):
                out.append(("owned", m.start(), m.end(), value))
        return out


def listed(spans: list) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the spans of every whole text; values leave the task as digests only."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("digest", pa.string())])

        def hashed(spans):
            return [{"kind": k, "start": a, "stop": b, "digest": hashlib.sha256(v.encode()).hexdigest()[:32]} for k, a, b, v in spans]

        for batch in batches:
            counts, digests, base, bare = {k: [] for k in LEAST}, [], [], []
            for value in batch.column(len(keep)):
                text = value.as_py() or ""
                found = scanner.base(text)
                for k in LEAST:
                    counts[k].append(sum(s[0] == k for s in found))
                digests.append(hashlib.sha256(listed(found).encode()).hexdigest())
                base.append(hashed(found))
                bare.append(hashed(scanner.bare_values(text, found)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), *(pa.array(counts[k], pa.int64()) for k in LEAST),
                 pa.array(digests, pa.string()), pa.array(base, pa.list_(span)), pa.array(bare, pa.list_(span))],
                names=[*keep, "n_assign", "n_access", "n_hex", "base_sha256", "base", "bare"],
            )

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + SCANNED
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def ownership(scanned: DataFrame, max_owners: int) -> DataFrame:
    """(digest, owners, repositories, example) of every candidate value in the corpus.

    Occurrences are first reduced to one row for each value, owner and
    repository, with partial aggregation, so a value copied into a third of
    the documents sends one row a task and owner.
    """
    every = scanned.select("_owner", "_repository", F.explode(F.concat("base", "bare")).alias("s"))
    one = every.groupBy(F.col("s.digest").alias("digest"), F.xxhash64("_owner", "_repository").alias("_place"), F.xxhash64("_owner").alias("_who")).agg(
        F.count(F.lit(1)).alias("n")
    )
    who = one.groupBy("digest", "_who").agg(F.count(F.lit(1)).alias("places"), F.sum("n").alias("n"))
    return who.groupBy("digest").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("places").alias("repositories"), F.sum("n").alias("occurrences")
    ).withColumn("example", F.col("owners") > max_owners)


def find_secrets(docs: DataFrame, *, owner: str = "source", repository: str = "lang", max_owners: int = 2) -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, and which of them look live.

    Three patterns give the base spans. Every long random-looking token beside
    them is a candidate too. All candidates' digests are aggregated over the
    corpus by distinct repositories (an owner's collection: ``owner`` with
    ``repository``) and owners: a value with more than ``max_owners`` owners is
    a widely copied example, any other looks live. Live bare candidates are
    added as spans of kind ``owned``; base spans always stay.

    ``live`` lists the spans whose value looks live, ``examples`` counts the
    others. Null texts are empty and have no spans; null owners count as one
    owner. Repeated rows each have their own row; an empty table gives none.
    Columns other than doc_id, text, owner and repository are not read.
    """
    named = docs.select("doc_id", F.col(owner).cast("string").alias("_owner"), F.col(repository).cast("string").alias("_repository"),
                        F.xxhash64("text").alias("text_hash"), "text")
    scanned = written(scan(named, ["doc_id", "_owner", "_repository", "text_hash"]).withColumn("_row", F.monotonically_increasing_id()))
    verdicts = ownership(scanned, max_owners).select("digest", "example")
    spans = scanned.select("_row", F.explode(F.concat("base", "bare")).alias("s")).withColumn("digest", F.col("s.digest")).join(verdicts, "digest")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("s.kind"))
    span = F.struct(F.col("s.start").alias("start"), order.alias("order"), F.col("s.kind").alias("kind"), F.col("s.stop").alias("stop"))
    by_row = spans.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.when((F.col("s.kind") != "owned") | ~F.col("example"), span))).alias("_all"),
        F.sort_array(F.collect_list(F.when(~F.col("example"), span))).alias("_live"),
        F.sum(F.col("example").cast("long")).alias("_examples"),
    )
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    return scanned.join(by_row, "_row", "left").select(
        "doc_id", "text_hash", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(F.transform("_all", text), ","), F.lit("")).alias("spans"),
        F.coalesce(F.transform("_live", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))), empty).alias("live"),
        F.coalesce("_examples", F.lit(0)).cast("long").alias("examples"),
    )


def redact(docs: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every live span replaced by ``mark``, and n_chars of the new text.

    Matched by doc_id (null to null) and the text's hash, so rows that share a
    doc_id keep their own spans.
    """
    side = found.where(F.size("live") > 0).groupBy(F.col("doc_id").alias("__llm_id"), F.col("text_hash").alias("__llm_hash")).agg(F.max("live").alias("__llm_live"))
    joined = docs.withColumn("__llm_text_hash", F.xxhash64("text")).join(side, F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_text_hash") == F.col("__llm_hash")), "left")

    # Pieces between the spans; overlapping spans are one.
    def pieces(live):
        start = F.aggregate(
            live, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda a, s: F.when(s["stop"] <= a["at"], a).otherwise(F.struct(
                s["stop"].alias("at"),
                F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("out"),
            )),
        )
        return F.concat(start["out"], F.substring(F.col("text"), start["at"] + 1, F.length("text")))

    text = F.when(F.col("__llm_live").isNull(), F.col("text")).otherwise(pieces(F.col("__llm_live")))
    out = joined.withColumn("text", text).withColumn("n_chars", F.when(F.col("__llm_live").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*docs.columns)
