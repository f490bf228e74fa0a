"""The stages of the pipeline, each on what its predecessor kept, against brute force."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline as pipeline

from .test_operators import WORD, brute_components, shingle_sets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = pipeline.documents(spark, SF)
    columns = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(path := str(tmp_path / name))
        before, docs = docs.collect(), spark.read.parquet(path)
        kept[name] = rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "language":
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
        if name == "exact_dedup":
            last = {r["text"]: r["doc_id"] for r in sorted(before, key=lambda r: r["doc_id"])}
            assert sorted(r["doc_id"] for r in rows) == sorted(last.values())
        if name == "near_dedup":
            stay = {c for _, n, c in brute_components(shingle_sets([(r["doc_id"], r["text"]) for r in before]))}
            assert sorted(r["doc_id"] for r in rows) == sorted(stay)
        if name == "mix":
            size = defaultdict(int)
            for r in before:
                size[r["source"]] += len(WORD.findall(r["text"]))
            mixed = defaultdict(int)
            for r in rows:
                mixed[r["source"]] += len(WORD.findall(r["text"]))
            total, weight, cap = sum(size.values()), {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}, {s: 3 * n for s, n in size.items()}
            full = set()
            while True:
                level = (total - sum(cap[s] for s in full)) / max(1, sum(weight[s] for s in size if s not in full))
                more = {s for s in size if s not in full and weight[s] * level > cap[s]}
                if not more:
                    break
                full |= more
            for s in size:
                assert abs(mixed[s] - (cap[s] if s in full else weight[s] * level)) <= 1
    places = defaultdict(list)
    for r in kept["packing"]:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in places.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
    assert pipeline.run(spark, SF).count() == len(kept["packing"])
