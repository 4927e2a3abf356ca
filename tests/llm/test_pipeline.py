"""The pipeline's stages against plain versions, on a small copy of the tables."""

from brute import mix_targets, similar, word_edits

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def _norm(t):
    import re

    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [_norm(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.cut(stage(spark, seen[-1], SF)))
    first, spoken, unique, clean, mixed, placed = seen
    assert all(d.columns == docs.columns for d in seen[:-1])
    assert spoken.count() == first.count()
    rows = sorted((r["doc_id"], r["text"]) for r in spoken.collect())
    kept = {r["doc_id"] for r in unique.collect()}
    # every row that went is like an earlier one that is linked to a kept row; no two kept rows are alike
    left = [r for r in rows if r[0] in kept]
    assert not any(similar(a[1], b[1]) for i, a in enumerate(left) for b in left[:i])
    assert all(any(similar(t, u) for j, u in rows if j != i) for i, t in rows if i not in kept)
    leak = {i for i, t in left if any(word_edits(x, _norm(t)) <= int(len(x) * 0.2 + 1e-9) for x in items if x)}
    assert {r["doc_id"] for r in clean.collect()} == kept - leak
    words = {(r["doc_id"], r["source"]): len((r["text"] or "").split()) for r in clean.collect()}
    sizes = {}
    for (_, s), n in words.items():
        sizes[s] = sizes.get(s, 0) + n
    want, taken = mix_targets(sizes), dict.fromkeys(sizes, 0)
    for r in mixed.collect():
        taken[r["source"]] += words[(r["doc_id"], r["source"])]
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] + 50 for s in sizes)
    got = placed.collect()
    assert len(got) == mixed.count() and {r["shard"] for r in got} <= set(range(8))
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
