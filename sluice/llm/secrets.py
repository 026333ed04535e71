"""Secrets in texts, told apart by who owns their value.

Three fixed patterns (assign, access, hex) always count. Beside them, tokens that look like live
credentials are candidates. Every candidate's value is known by its SHA-256 alone; Spark counts, over the
whole corpus, in how many distinct repositories and at how many distinct owners a value stands. A value of
several owners and several repositories is an example that people copy; one that stays with few owners is
owner-specific, and a live-looking token of that kind becomes a span of kind `owned`.

Special cases. A null text is empty: no spans, the hash of an empty string. Nulls are an owner of their
own. Rows of equal ids or texts are each answered; equal texts are one repository by default, so that a
document that is mirrored a thousand times doesn't turn its secrets into examples. A document's spans are
gathered in its own row, so their number is bounded by its text and not by the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import keep_written, lean, scratch, trim, written

# Kinds in their order, and the patterns.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST = {"assign": 8, "access": 16, "hex": 32}

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# Runs are taken whole, so that a least length in the pattern drops the same matches as a look at them afterwards.
_access = re.compile(rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}")
_hex = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}")

#: Letters of a token that looks live, and different ones among them, at least; it has small and capital letters and digits.
TOKEN, DISTINCT = 20, 12
_token = re.compile(rf"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{{{TOKEN},}}", re.ASCII)

#: A value of more owners than this, and of more repositories, is a copied example.
OWNERS, REPOSITORIES = 2, 2

#: Values with more than one in so many of all candidates are joined by broadcast: there are fewer than this of them.
HOT = 1000

_FOUND = "row long, doc_id long, owner string, repository binary, n_assign long, n_access long, n_hex long, base string, found array<struct<start:int,kind:int,end:int,value:binary>>"
_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("owner", pa.string()), ("repository", pa.binary()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("found", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.binary())])))])


def looks_live(token: str) -> bool:
    return len(set(token)) >= DISTINCT and any("0" <= c <= "9" for c in token) and any("a" <= c <= "z" for c in token) and any("A" <= c <= "Z" for c in token)


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) by start, then kind: the fixed patterns' matches, and live-looking tokens that no such match overlaps."""
    base = [(m.start(), 0, m.end(), m[2]) for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]] if ":" in text or "=" in text else []
    base += [(m.start(), 1, m.end(), m[0]) for m in _access.finditer(text)]
    base += [(m.start(), 2, m.end(), m[0]) for m in _hex.finditer(text)]
    base.sort()
    spans, at, reach = [], 0, 0
    for m in _token.finditer(text):
        if not looks_live(m[0]):
            continue
        # tokens rise, so a match that ends before one of them can't overlap a later one
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start():
            spans.append((m.start(), 3, m.end(), m[0]))
    return sorted(base + spans)


def written_spans(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, *_ in spans)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        out = []
        for doc, owner, repository, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "owner", "repository", "text")), strict=True):
            found = candidates(text or "")
            kinds = [s[1] for s in found]
            out.append({"row": row, "doc_id": doc, "owner": owner, "repository": repository, "n_assign": kinds.count(0), "n_access": kinds.count(1), "n_hex": kinds.count(2), "base": written_spans(s for s in found if s[1] < 3), "found": [{"start": s, "kind": k, "end": e, "value": hashlib.sha256(v.encode()).digest()} for s, k, e, v in found]})
            row += 1
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
    trim()


def frequencies(found: DataFrame) -> DataFrame:
    """value, n, owners, repositories of candidates (value, owner, repository): distinct counts, summed before they are dealt out, so that no value makes a hot task."""
    return found.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("owner")).alias("owners"), F.count_distinct(F.struct("repository")).alias("repositories"))


def judged(found: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """found (value, and other columns) with `copied`: whether its value is an example. Frequent values, fewer than HOT, come by broadcast, the rest by a join in which none is frequent."""
    verdicts = written(frequencies(found).select("value", "n", ((F.col("owners") > owners) & (F.col("repositories") > repositories)).alias("copied")), "secret-values")
    total = verdicts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * HOT > total
    hot = F.broadcast(verdicts.filter(often).select("value", "copied"))
    rest = found.join(hot.select("value"), "value", "left_anti").join(verdicts.filter(~often).select("value", "copied"), "value")
    return found.join(hot, "value").unionByName(rest)


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, copied.

    docs: doc_id and text are read, and what owner (the source) and repository (the text itself) are made
    of. spans: the fixed patterns' and the owned ones, as kind:start:end by start, then kind. copied: those
    of the spans, alike, whose value is an example found at several owners. See the module's special cases.
    """
    spark = lean(docs.sparkSession)
    owner = F.col("source") if owner is None else owner
    repository = F.sha2(F.col("text").cast("binary"), 256) if repository is None else repository
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repository.cast("binary").alias("repository"), F.col("text").cast("string").alias("text"))
    with scratch(spark):
        found = written(frame.mapInArrow(_find, _FOUND), "secrets")
        each = found.filter(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("f")).select("row", "owner", "repository", "f.*")
        kept = judged(each, owners, repositories).filter((F.col("kind") < 3) | ~F.col("copied"))
        named = F.element_at(F.array(*map(F.lit, KINDS)), F.col("s.kind") + 1)
        shown = kept.select("row", F.struct("start", "kind", "end", "copied").alias("s")).select("row", "s", F.concat_ws(":", named, "s.start", "s.end").alias("shown"))
        marks = shown.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "shown"))).alias("all"))
        text = lambda spans: F.array_join(F.transform(spans, lambda x: x["shown"]), ",")
        none = F.array().cast("array<struct<s:struct<start:int,kind:int,end:int,copied:boolean>,shown:string>>")
        spans = F.coalesce(F.col("all"), none)
        return keep_written(
            found.drop("found", "owner", "repository")
            .join(marks, "row", "left")
            .select(
                "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), text(spans).alias("spans"),
                F.size(F.filter(spans, lambda x: x["s"]["kind"] == 3)).cast("long").alias("n_owned"), text(F.filter(spans, lambda x: x["s"]["copied"])).alias("copied"),
            ),
            "secret-spans",
        )
