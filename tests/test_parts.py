"""Files that tasks write in one job."""

import pytest

from sluice.errors import FileError
from sluice.operators import clip
from sluice.sources import sink, turtle
from sluice.sources.parts import PartsWriter, Written


def statements(spark, n, files, p="http://e/p"):
    """n statements dealt over files, a third of them in the first, with blank nodes in each."""
    return spark.range(n).selectExpr(
        f"concat('f', if(id % 3 = 0, 0, id % {files}), '.ttl') as file", "if(id % 5 = 0, concat('_:x', id % 7), concat('http://e/s', id)) as s", f"'{p}' as p",
        "cast(id as string) as o", "'L' as kind", "cast(null as string) as lang", "cast(null as string) as dt", "id as pos",
    )


def plain(df):
    return sorted((r["s"].split(".")[-1].removeprefix("_:"), r["p"], r["o"]) for r in df.collect())


@pytest.mark.parametrize("split", [False, True])
def test_all_parts_in_one_job(spark, tmp_path, split):
    """97 files, one of them without a statement, whole and in their order."""
    rows = statements(spark, 5000, 96)
    folder = tmp_path / "out"
    sink.write_parts(rows, str(folder), {"e": "http://e/"}, [f"f{i}.ttl" for i in range(97)], split)
    assert sorted(p.name for p in folder.iterdir()) == sorted(f"f{i}.ttl" for i in range(97))
    assert plain(turtle.read(spark, f"{folder}/*.ttl", keep_labels=True)) == plain(rows)
    files = sorted((folder / "f0.ttl").iterdir()) if split else [folder / "f0.ttl"]
    assert len(files) > 1 or not split
    texts = [f.read_text() for f in files]
    assert all(t.startswith("# labels of ") == split and "@prefix e: <http://e/> ." in t for t in texts)
    values = [int(line.split('"')[1]) for t in texts for line in t.splitlines() if '"' in line]
    assert values == sorted(values) and set(values) == {r["pos"] for r in rows.filter("file = 'f0.ttl'").collect()}
    assert len({r["s"] for r in turtle.read(spark, str(folder / "f0.ttl")).collect() if r["s"].startswith("_:")}) == 7
    assert turtle.read(spark, str(folder / "f96.ttl")).count() == 0


def test_what_is_replaced_and_what_stays(spark, tmp_path):
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "notes.txt").write_text("mine")
    sink.write_parts(statements(spark, 900, 3), str(folder), split=True)
    sink.write_parts(statements(spark, 30, 1, "http://e/q"), f"file://{folder}")  # a file where a folder was
    assert sorted(p.name for p in folder.iterdir()) == ["f0.ttl", "f1.ttl", "f2.ttl", "notes.txt"]
    assert plain(turtle.read(spark, str(folder / "f0.ttl"), keep_labels=True)) == plain(statements(spark, 30, 1, "http://e/q"))
    sink.write_parts(statements(spark, 30, 1), str(folder), mode="overwrite")
    assert [p.name for p in folder.iterdir()] == ["f0.ttl"]
    sink.write_parts(statements(spark, 0, 1), str(tmp_path / "empty"))
    assert list((tmp_path / "empty").iterdir()) == []


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    rows = statements(spark, 2000, 5)
    bad = rows.withColumn("o", rows.o.substr(1, 9)).selectExpr("file", "s", "p", "if(pos = 1999, raise_error('oops'), o) as o", "kind", "lang", "dt", "pos")
    with pytest.raises(Exception, match="oops"):
        sink.write_parts(bad, str(tmp_path / "new"))
    assert not (tmp_path / "new").exists()
    sink.write_parts(rows, str(tmp_path / "old"))
    before = {p.name: p.read_bytes() for p in (tmp_path / "old").iterdir()}
    for name in ("null", "'../x'", "'/x'", "'.x'", "''", "'a//b'"):
        with pytest.raises(Exception, match="no name of a file"):
            sink.write_parts(rows.selectExpr(f"if(pos = 7, {name}, file) as file", "s", "p", "o", "kind", "lang", "dt", "pos"), str(tmp_path / "old"), mode="overwrite")
        assert {p.name: p.read_bytes() for p in (tmp_path / "old").iterdir()} == before


def test_lines_of_a_file_stay_together(spark, tmp_path):
    turtle.register(spark)
    lines = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "file string, line string")
    for apart, message in ((lines.coalesce(1), "not together"), (lines.repartitionByRange(3, "line"), "more than one task")):
        with pytest.raises(Exception, match=message):
            apart.write.format("turtle").mode("append").save(str(tmp_path / "out"))
        assert not (tmp_path / "out").exists()
    with pytest.raises(Exception, match="columns file and line"):
        spark.range(1).write.format("turtle").mode("append").save(str(tmp_path / "out"))


def test_an_attempt_that_did_not_count(tmp_path):
    """A commit takes what the messages name, and clears what other attempts left."""
    import pyarrow as pa

    writer = PartsWriter(str(tmp_path / "out"), "", False)
    batch = pa.RecordBatch.from_pydict({"line": ["x", None, "y"], "file": ["a", "a", "d/b"]})
    lost, got = writer.write(iter([batch])), writer.write(iter([batch]))
    assert isinstance(lost, Written) and got.files == ["a", "d/b"]
    writer.commit([got, None])
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*")) == ["out", "out/a", "out/d", "out/d/b"]
    assert (tmp_path / "out" / "a").read_text() == "x\n"
    with pytest.raises(FileError, match="more than one task"):
        writer.commit([got, lost])


def test_a_cut_in_ranges_merges_back(spark, tmp_path):
    """Parts that are folders of ranges give the graph that they were cut from."""
    from tests.test_network import HEAD, NETWORK

    (tmp_path / "net.ttl").write_text(HEAD + NETWORK)
    square = lambda a, b: f"[[[{a},-50],[{b},-50],[{b},50],[{a},50],[{a},-50]]]"
    (tmp_path / "b.geojson").write_text('{"features":[' + ",".join(f'{{"properties":{{"n":"{n}"}},"geometry":{{"type":"Polygon","coordinates":{square(a, b)}}}}}' for n, a, b in (("West", 0, 20), ("East", 20, 80))) + "]}")
    told = []

    class Told:
        def begin(self, phase, total):
            told.append((phase, total))

        def step(self, done):
            told.append(done)

        def end(self):
            pass

    files = clip.clip_file(spark, str(tmp_path / "net.ttl"), str(tmp_path / "b.geojson"), str(tmp_path / "parts"), "n", progress=Told(), split=True)
    assert [f.rsplit("/", 1)[-1] for f in files] == ["West.ttl", "East.ttl"] and all((tmp_path / "parts" / n).is_dir() for n in ("West.ttl", "East.ttl"))
    assert told == [("plan", None), ("write", 2), 2]
    clip.merge_files(spark, files, str(tmp_path / "back.ttl"))
    sign = lambda p: sink.isomorphic_fingerprint(turtle.load(spark, str(tmp_path / p)).triples).first()
    assert sign("back.ttl") == sign("net.ttl")


@pytest.mark.parametrize("seed", range(2))
def test_sets_of_blocks_go_up_and_down(spark, seed):
    """Both loops against plain rounds over the whole state, on holders with rings, several holders and members without statements."""
    import random

    deal = random.Random(seed)
    names = [f"n{i}" for i in range(40)]
    edges = {(deal.choice(names[: i + 1] if deal.random() < 0.9 else names), n) for i, n in enumerate(names) for _ in range(deal.randint(0, 2))}
    edges = sorted(e for e in edges if e[0] != e[1])
    pairs = {(deal.choice(names), deal.choice(names)) for _ in range(30)}
    pairs = sorted({p for a, b in pairs if a != b for p in ((a, b), (b, a))})
    seeds = {n: deal.randint(1, 2**5 - 1) for n in names if deal.random() < 0.15}
    subjects = [n for n in names if deal.random() < 0.9]

    plan = object.__new__(clip.Plan)
    plan.sets, plan.own = clip.Sets(5), spark.createDataFrame([], "b string, owner string")
    plan.graph = type("G", (), {"triples": spark.createDataFrame([(n,) for n in subjects], "s string")})
    frame = lambda rows, c: spark.createDataFrame(rows, ", ".join(f"{x} string" for x in c))
    masks = spark.createDataFrame([(n, [m]) for n, m in seeds.items()], "block string, mask array<long>")
    held, joined = frame(edges, ("holder", "member")), frame(pairs, ("x", "y"))

    up = dict(seeds)
    while True:
        more = {h: up.get(h, 0) | up[m] for h, m in edges if m in up}
        for h, m in edges:
            if m in up:
                more[h] |= up[m]
        if all(up.get(h) == v for h, v in more.items()):
            break
        up |= more
    down = dict(up)
    while True:
        got = {}
        for n in subjects:
            mine = 0
            for h, m in edges:
                if m == n and h in down:
                    mine |= down[h]
            if n not in down and mine:
                near = 0
                for x, y in pairs:
                    if x == n and y in down:
                        near |= down[y]
                got[n] = mine & near if mine.bit_count() > 1 and mine & near else mine
        if not got:
            break
        down |= got
    down |= {n: 2**5 - 1 for n in subjects if n not in down}
    read = lambda df: sorted((r["block"], r["mask"][0]) for r in df.collect())
    above = plan._up(masks, held, 100)
    assert read(above) == sorted(up.items())
    assert read(plan._down(above, held, joined, 100)) == sorted(down.items())
