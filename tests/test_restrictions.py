"""Queries over the ontology from `part` answer for every part, against brute force."""

from collections import Counter

from sluice.plans import queries as plans
from sluice.sources.tables import TERMS

KEYS = [*range(20), *range(190, 215), 1999, 2004, 20_043, 200_430]


def by_hand(sizes):
    base = TERMS.base
    facets = {k: ("decimal" if k % 2 else "integer", str(k % 50), str(n + 50) if k % 5 else None) for k, n in sizes.items()}
    function = {}
    for k in sizes:
        up, at = [], k
        while at >= 10:
            at //= 10
            up.append(at)
        found = [k] if k % 4 == 0 else sorted((x for x in up if x % 4 == 0 and x in sizes), key=lambda x: f"F_{x}")
        if found:
            function[k] = f"Doen_{found[0] % 7}"
    owners = [("r", "K")] + [(t, "Dt") for t in ("e", "x", "y", "lo", "hi")]
    return {
        "facet_range": [(f"{base}Dt_{k}", *f) for k, f in facets.items()],
        "attribute_range": [(f"{base}K_{k}", *f) for k, f in facets.items() if k % 3 and k % 4 != 3],
        "expected_property": [(f"K_{k}", "hasValue" if k % 3 else "hasReference") for k in sizes if k % 3 or k % 4 != 3],
        "class_function_inherited": [(f"{base}F_{k}", f) for k, f in function.items()],
        "block_owner_of_bnode": [(f"_:{t}{k}", f"{base}{o}_{k}") for k in sizes for t, o in owners] + [(f"_:f{k}", f"{base}F_{k}") for k in sizes if k % 4 == 0],
    }


def test_every_part_is_answered(spark, tmp_path):
    # All ancestors of a key are there, so that chains of classes are whole.
    keys = sorted({k // 10**i for k in KEYS for i in range(6)})
    sizes = {k: k * 7 % 50 + 1 for k in keys}
    spark.createDataFrame(list(sizes.items()), "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    for name, want in by_hand(sizes).items():
        got = plans.QUERIES[name](spark, str(tmp_path)).collect()
        assert Counter(map(tuple, got)) == Counter(want), name
