"""The pipeline's stages, each on what the one before kept."""

from __future__ import annotations

from pathlib import Path

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from tests.llm.test_operators import slow_components, slow_cut, slow_fingerprint, slow_lines  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no driver tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        made = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert made.columns == columns
            before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in made.collect()}
        if name == "language":
            assert set(before) - set(after) == {i for i, t in before.items() if not any(c.isalpha() for c in t or "")}
        elif name == "lines":
            gone = slow_lines(list(before.items()))
            assert after == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in before.items()}
        elif name == "near_duplicates":
            part = slow_components({i: slow_fingerprint(t) for i, t in before.items()})
            assert set(after) == set(part.values())
        elif name == "substrings":
            want = {i: w[1] for i, w in zip(before, slow_cut([t.encode() for t in before.values()], 400))}
            assert all(len(before[i].encode()) - len(after[i].encode()) - want[i] in range(4 * (want[i] > 0) * 2 + 1) for i in before)
        else:
            assert made.select("doc_id").distinct().count() == docs.count()
        docs = made
