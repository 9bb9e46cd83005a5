from __future__ import annotations

import hashlib

import pytest
from llm.made import prose

import corpus_pipeline
from funnelwright.llm import simhash


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    item = prose(77, 40)
    rows = [(i, prose(i, 60 + i), "en" if i % 2 else "de", f"src{i % 3}") for i in range(60)]
    for d, *_ in list(rows)[:25]:
        value = hashlib.sha1(str(d).encode()).hexdigest()
        rows[d] = (d, f'{rows[d][1]} token = "{value}" and {int(value, 16) % 10**16:016d}', *rows[d][2:])
    edited = prose(30, 90).split()
    edited[50] = "edited"
    rows += [(100, rows[31][1], "en", "src0"), (101, " ".join(edited), "de", "src0"), (102, f"{prose(5, 20)} {item} {prose(6, 9)}", "en", "src1"),
             (103, "12 34 !!", "en", "src0"), (104, None, "en", "src0"), (105, "", None, None),
             (None, rows[9][1].upper(), None, None), (None, prose(500, 70), None, None)]
    path = tmp_path_factory.mktemp("tables")
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], columns)
    docs.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return rows, str(path)


def copies(rows):
    """Ids of documents with a smaller one within three bits, by chains, by brute force."""
    rows = [r for r in rows if r[0] is not None and r[0] not in (103, 104, 105)]
    fps = {r[0]: simhash.fingerprint(simhash.shingle_hashes(r[1], 3)) for r in rows}
    gone, todo = set(), sorted(fps)
    while todo:
        group = [todo.pop(0)]
        for own in group:
            close = [d for d in todo if (fps[own] ^ fps[d]).bit_count() <= 3]
            group += close
            todo = [d for d in todo if d not in close]
        gone |= set(group[1:])
    return gone


def test_stages(spark, tables):
    rows, path = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, path))
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        nameless = [r.text for r in docs.where("doc_id is null").collect()]
        assert prose(500, 70) in nameless and (rows[9][1].upper() in nameless) == (name == "language")
        assert docs.columns[: len(before)] == before
    everything = {r[0] for r in rows}
    assert set(kept["language"]) == everything - {103, 104, 105}
    assert set(kept["near_dedup"]) == set(kept["language"]) - copies(rows)
    assert 100 in copies(rows)
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - {102}
    assert sorted(kept["secret_scan"], key=str) == sorted(kept["decontamination"], key=str)
    texts = [r.text for r in docs.collect()]
    assert any("[secret]" in t for t in texts)
    assert not any(hashlib.sha1(str(d).encode()).hexdigest() in t for t in texts for d in range(25))
    again = corpus_pipeline.run(spark, path).select("doc_id", "epoch", "block_rank", "doc_rank").collect()
    assert sorted(again, key=str) == sorted(docs.select("doc_id", "epoch", "block_rank", "doc_rank").collect(), key=str)
    assert len(corpus_pipeline.STAGES) == 5


def test_empty_documents(spark, tables):
    empty = spark.read.parquet(f"{tables[1]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.cut_lineage(stage(spark, empty, tables[1]))
    assert empty.count() == 0
