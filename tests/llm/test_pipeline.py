"""Every stage on the smallest tables, against plain versions of what it promises."""

from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import WORD, jaccard_by_hand, targets_by_hand

DATA = Path("/root/testdata/sf0.001")


def kept_by_hand(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append(" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def good_quality(spark, docs, out):
    from sluice.llm import quality

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.train(docs, labels, F.lit(True))
    rows = docs.collect()
    want = Counter(r for r, s in zip(rows, model.score([r["text"] or "" for r in rows]), strict=True) if s >= quality.ACCEPT)
    assert Counter(out.collect()) == want and 0 < sum(want.values()) < len(rows)


def one_of_each_group(spark, docs, out):
    rows = docs.collect()
    by_class = defaultdict(list)
    for r, (n, c) in zip(rows, jaccard_by_hand([r["text"] for r in rows]), strict=True):
        by_class[c if n else ("empty", len(by_class))].append(r)
    got = Counter(out.collect())
    assert sum(got.values()) == len(by_class)
    for group in by_class.values():
        ids = [r["doc_id"] for r in group if r["doc_id"] is not None]
        assert any(got[r] for r in group if r["doc_id"] == (min(ids) if ids else None))


def no_repeated_passages(spark, docs, out):
    rows = docs.collect()
    want = Counter((r["doc_id"], r["lang"], r["source"], t, len(t)) for r, t in zip(rows, kept_by_hand([r["text"] for r in rows]), strict=True))
    assert Counter((r["doc_id"], r["lang"], r["source"], r["text"], r["n_chars"]) for r in out.collect()) == want


def mixed_sources(spark, docs, out):
    size = lambda r: len(WORD.findall(r["text"] or ""))
    rows, taken = docs.collect(), out.collect()
    sizes, got, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += size(r)
        largest[r["source"]] = max(largest[r["source"]], size(r))
    for r in taken:
        got[r["source"]] += size(r)
    want = targets_by_hand(sizes)
    assert all(abs(got[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    have, took = Counter(rows), Counter(taken)
    assert set(took) <= set(have) and all(took[r] <= 2 * have[r] for r in took)


def packed(spark, docs, out):
    from sluice.llm import packing
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for r in docs.collect():
        n = len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        want.update((r["doc_id"], k, start, length) for k, (start, length) in enumerate(packing.pieces(n, 1024)))
    rows = out.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == np.concatenate([[0], np.cumsum([n for _, n in parts])])[:-1].tolist() and sum(n for _, n in parts) <= 1024


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_stages(spark):
    import corpus_pipeline as p
    from sluice.llm.shared import written

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    # Repeated rows, rows without an id, and an id on rows with unlike texts.
    odd = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.unionAll(docs.limit(2)).unionAll(odd).unionAll(odd).unionAll(docs.limit(1).withColumn("text", F.lit("one text of its own under an id that another text has as well")))
    docs = written(docs, "documents")
    checks = {"quality": good_quality, "near_duplicates": one_of_each_group, "repeated_passages": no_repeated_passages, "mixing": mixed_sources, "packing": packed}
    for name, stage in p.STAGES:
        out = written(stage(spark, docs, str(DATA)), name)
        if name != "packing":
            assert out.columns == docs.columns
        checks[name](spark, docs, out)
        empty = stage(spark, docs.limit(0), str(DATA))
        assert empty.count() == 0
        docs = out


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_run_leaves_its_result_alone(spark, tmp_path, monkeypatch):
    import corpus_pipeline as p
    from sluice.llm import shared

    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = p.run(spark, str(DATA))
    assert out.columns[:3] == ["doc_id", "piece", "start"] and out.count() > 0
    assert {f.name.split("-")[1] for f in tmp_path.iterdir()} == {"packing"}


def test_registry(spark):
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
