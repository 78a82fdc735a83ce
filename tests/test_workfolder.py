"""Work folders: stopped runs, repeated runs, documents that are done again."""

import json

import pytest

from tessera.operators import chunks, workfolder
from tests import rows as R


def docs(spark, *ids, text=R.LOG):
    return spark.createDataFrame([(k, text) for k in ids], "doc_id long, text string")


def test_a_stopped_run_is_not_seen_and_resumes(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    assert workfolder.manifest(spark, path) is None and workfolder.not_done(docs(spark, 1, 2), path).count() == 2
    workfolder.extract(docs(spark, 1, None), path, 1, 30)
    first = workfolder.read(spark, path, "blocks").count()

    def stop(planned):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(chunks, "chunk_files", stop)
        with pytest.raises(OSError):
            workfolder.extract(docs(spark, 1, 2, 3), path, 2, 30)
    assert (tmp_path / "blocks" / "run=2").is_dir() and workfolder.read(spark, path, "blocks").count() == first
    assert sorted(r.doc_id for r in workfolder.not_done(docs(spark, 1, 2, 3, None), path).collect()) == [2, 3]
    # The run is taken up with fewer documents: nothing of its stopped attempt stays.
    done = workfolder.extract(docs(spark, 1, 3), path, 2, 30).collect()
    assert [(r.doc_id, r.problem) for r in done] == [(3, None)]
    assert {r.doc_id for r in workfolder.read(spark, path, "blocks").collect()} == {1, 3, None}
    assert [r.doc_id for r in workfolder.not_done(docs(spark, 1, 2, 3), path).collect()] == [2]
    assert workfolder.extract(docs(spark, 1, 3), path, 3, 30).count() == 0


def test_documents_done_again(spark, tmp_path):
    """The latest run of a document counts, with all of its tables; documents without text are finished as such."""
    path = str(tmp_path)
    for run, (text, target) in enumerate([(R.LOG, 5), ("Only one line here.", 30)]):
        frame = spark.createDataFrame([(1, text), (2 + run, R.LOG), (9, "")], "doc_id long, text string")
        from tessera.operators import blocks
        from tessera.sources import documents as D

        workfolder.write_run(frame, blocks.build_blocks(D.lines(frame)), path, run, target, D.pages(frame))
    assert {(r.doc_id, r.run, r.problem) for r in workfolder.manifest(spark, path).collect()} == {(1, 1, None), (2, 0, None), (3, 1, None), (9, 1, "no text")}
    per = {name: {} for name in workfolder.TABLES}
    for name in per:
        for r in workfolder.read(spark, path, name).collect():
            per[name].setdefault(r.doc_id, []).append(r)
    assert [r.text for r in per["blocks"][1]] == ["Only one line here."] and len(per["chunks"][1]) == 1 and len(per["chunks"][2]) > len(per["chunks"][3]) > 0
    assert [len(per["chunk_files"][k]) for k in (1, 2, 3)] == [len(per["chunks"][k]) for k in (1, 2, 3)] and per["pages"][1][0].text == "Only one line here."
    told = json.loads(per["documents"][2][0].json)
    assert told["title"] == "Rain Gauge Log of the Upper Meadow" and [c["file"] for c in told["chunks"]] == sorted(r.file for r in per["chunk_files"][2]) and "stands on a post" in per["documents"][2][0].source
    with pytest.raises(FileNotFoundError):
        workfolder.read(spark, str(tmp_path / "other"), "blocks")
