"""Dumps, sinks, artefacts and the file stream."""

import gzip
import io
import json
import lzma
import os

import pytest
from frames import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from forumlens.sources import dumps, summaries, tables, xz
from forumlens.streaming.dumps import append_new_dumps


def write_lines(path, records):
    path.write_text("".join(json.dumps(r) + "\n" if isinstance(r, dict) else r + "\n" for r in records))


def test_dump_with_broken_line(spark, tmp_path):
    write_lines(tmp_path / "RC_1.json", [{"id": "a", "score": 3, "extra": 1}, "no json", {"id": "b"}])
    got = dumps.read_dump(spark, str(tmp_path / "RC_1.json"), dumps.COMMENT_SCHEMA)
    assert rows(got.select("id", "score", "source_file"), "id") == [
        (None, None, "RC_1.json"),
        ("a", 3, "RC_1.json"),
        ("b", None, "RC_1.json"),
    ]
    assert [r[0] for r in got.where("id is null").select("_corrupt_record").collect()] == ["no json"]


def test_zstd_dump(spark, tmp_path):
    import zstandard

    data = json.dumps({"id": "a", "body": "é"}).encode() + b"\n"
    (tmp_path / "RC_2.zst").write_bytes(zstandard.compress(data))
    got = dumps.read_dump(spark, str(tmp_path / "RC_2.zst"), dumps.COMMENT_SCHEMA)
    assert rows(got.select("id", "body")) == [("a", "é")]


def xz_file(path, parts):
    """One .xz stream with a block for each part."""
    body, records = b"", []
    for part in parts:
        stream = lzma.compress(part, lzma.FORMAT_XZ)
        (block,) = xz.find_blocks(io.BytesIO(stream), len(stream))
        body += stream[12 : 12 + -(-block.packed // 4) * 4]
        records.append((block.packed, block.size))
    path.write_bytes(xz._header(b"\0\4") + body + xz._tail(b"\0\4", records))
    assert lzma.decompress(path.read_bytes()) == b"".join(parts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"bc", b"\n", b"\n\n", b"xyz" * 40]), max_size=40), st.lists(st.integers(0, 200)), st.integers(1, 3))
def test_xz_lines_do_not_depend_on_blocks(pieces, cuts, step):
    text = b"".join(pieces)
    borders = sorted({0, len(text), *(c for c in cuts if c < len(text))})
    streams = [lzma.compress(text[a:b]) + b"\0" * (4 * (a % 3)) for a, b in zip(borders, borders[1:])]
    file = io.BytesIO(b"".join(streams))
    blocks = xz.find_blocks(file, len(file.getvalue()))
    got = [x for i in range(0, len(blocks), step) for some in xz.lines_of(file, blocks, i, i + step) for x in some]
    assert got == (text[:-1] if text.endswith(b"\n") else text).split(b"\n") * bool(text)


def test_xz_dump_is_a_task_a_block(spark, tmp_path):
    lines = [json.dumps({"id": str(i), "body": "é" * i}).encode() + b"\n" for i in range(200)]
    text = b"".join(lines[:150]) + b"no json\n\n" + b"".join(lines[150:])[:-1]
    xz_file(tmp_path / "RC_3.xz", [text[i : i + 5000] for i in range(0, len(text), 5000)])
    got = dumps.read_dump(spark, str(tmp_path / "RC_3.xz"), dumps.COMMENT_SCHEMA)
    assert got.rdd.getNumPartitions() == -(-len(text) // 5000)
    assert xz.read_xz_lines(spark, [str(tmp_path)], 20_000).rdd.getNumPartitions() == -(-len(text) // 20_000)
    assert sorted((r.id, r.body, r.source_file) for r in got.where("id is not null").collect()) == sorted(
        (str(i), "é" * i, "RC_3.xz") for i in range(200)
    )
    assert [r._corrupt_record for r in got.where("id is null").collect()] == ["no json"]


def test_folder_of_all_codecs(spark, tmp_path):
    write_lines(tmp_path / "1.json", [{"id": "a"}])
    (tmp_path / "2.json.gz").write_bytes(gzip.compress(b'{"id": "b"}\n'))
    xz_file(tmp_path / "3.xz", [b'{"id": "c"}\n{"i', b'd": "d"}'])
    got = dumps.read_dump(spark, str(tmp_path), dumps.COMMENT_SCHEMA)
    assert rows(got.select("id", "source_file"), "id") == [("a", "1.json"), ("b", "2.json.gz"), ("c", "3.xz"), ("d", "3.xz")]


@pytest.mark.parametrize("harm", [lambda x: b"x", lambda x: x[:-1], lambda x: x[40:], lambda x: x[:-20] + b"xx" + x[-18:]])
def test_broken_xz_is_an_error(spark, tmp_path, harm):
    (tmp_path / "RC_4.xz").write_bytes(harm(lzma.compress(b'{"id": "a"}\n' * 1000)))
    with pytest.raises(Exception, match="no finished .xz file"):
        dumps.read_dump(spark, str(tmp_path / "RC_4.xz"), dumps.COMMENT_SCHEMA).count()


def test_damaged_xz_block_is_an_error(spark, tmp_path):
    good = bytearray(lzma.compress(os.urandom(5000)))
    good[2500] ^= 1
    (tmp_path / "RC_5.xz").write_bytes(good)
    with pytest.raises(Exception, match="Corrupt"):
        dumps.read_dump(spark, str(tmp_path / "RC_5.xz"), dumps.COMMENT_SCHEMA).count()


def test_xz_sink_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    lines = spark.range(1000).selectExpr("concat('line ', id) as value")
    for _ in range(2):
        xz.write_xz_lines(lines.repartition(3), path, "overwrite", block_bytes=1000)
    xz.write_xz_lines(spark.createDataFrame([("more",)], "value string"), path)
    xz.write_xz_lines(lines.limit(0), path)
    got = xz.read_xz_lines(spark, [path])
    assert sorted(r.value for r in got.collect()) == sorted([*(f"line {i}" for i in range(1000)), "more"])
    assert len(list((tmp_path / "out").glob("*.xz"))) == 4 and got.rdd.getNumPartitions() >= 10
    assert not [x for x in os.listdir(path) if x.startswith("_temporary")]
    for file in (tmp_path / "out").glob("*.xz"):
        assert lzma.decompress(file.read_bytes()).endswith(b"\n")


def test_nul_scrub(spark):
    df = spark.createDataFrame([("a\0b", 1)], "t STRING, n INT")
    assert rows(tables.scrub_nul(df)) == [("ab", 1)]


def test_table_sink(spark, tmp_path):
    df = spark.createDataFrame([(5, "x\0"), (2, "y")], "k INT, t STRING")
    path = str(tmp_path / "t")
    tables.write_table(df, path, "overwrite", index_label="i", index_key="k")
    assert rows(spark.read.parquet(path), "i") == [(2, "y", 0), (5, "x", 1)]
    tables.write_table(df.selectExpr("k", "t", "CAST(9 AS BIGINT) AS i"), path)
    assert spark.read.parquet(path).count() == 4


def test_csv_sink(spark, tmp_path):
    path = str(tmp_path / "c")
    tables.write_csv(spark.createDataFrame([("a;b", 1)], "t STRING, n INT"), path)
    back = spark.read.option("sep", ";").option("header", True).schema("t STRING, n INT").csv(path)
    assert rows(back) == [("a;b", 1)]


def test_artefacts_are_computed_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    path = tables.artefact_path(str(tmp_path), "ids", n=3, seed=1)
    assert path.endswith("ids/n=3/seed=1")
    for _ in range(2):
        assert tables.load_or_compute(spark, path, compute).count() == 3
    assert len(calls) == 1


def test_model_artefacts(spark, tmp_path):
    from pyspark.ml.feature import CountVectorizerModel

    path = str(tmp_path / "m")
    for words in (["a", "b"], ["never", "used"]):
        model = tables.load_or_fit(path, CountVectorizerModel.load, lambda: CountVectorizerModel.from_vocabulary(words, "x", "y"))
        assert list(model.vocabulary) == ["a", "b"]


def test_run_summary_export(spark):
    long = summaries.long_metrics(spark.createDataFrame([(2, 15, 3.5), (2, 20, 2.5)], "min_df INT, k INT, inertia DOUBLE"), ["min_df", "k"], ["inertia"])
    assert rows(long, "k") == [(2, 15, "inertia", 3.5), (2, 20, "inertia", 2.5)]
    models = json.loads(summaries.nested_summary(long, ["min_df"], ["k"]).first().models)
    assert [(m["k"], m["metrics"]) for m in models] == [(15, {"inertia": 3.5}), (20, {"inertia": 2.5})]


def test_stream_takes_every_dump_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        query = append_new_dumps(
            spark, str(folder), dumps.COMMENT_SCHEMA, lambda b: b.where("score > 1").select("id", "source_file"), out, state
        )
        query.awaitTermination()
        return rows(spark.read.parquet(out).select("id", "source_file"), "id")

    write_lines(folder / "1.json", [{"id": "a", "score": 5}, {"id": "b", "score": 0}])
    assert run() == [("a", "1.json")]
    write_lines(folder / "2.json", [{"id": "c", "score": 5}])
    assert run() == [("a", "1.json"), ("c", "2.json")]
    assert run() == [("a", "1.json"), ("c", "2.json")]


def test_stream_reads_xz_and_keeps_broken_lines(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    write_lines(folder / "1.json", [{"id": "a", "score": 5}, "no json"])

    def run():
        append_new_dumps(spark, str(folder), dumps.COMMENT_SCHEMA, lambda b: b.select("id", "_corrupt_record"), out, state).awaitTermination()

    run()
    assert rows(spark.read.parquet(out).select("id", "_corrupt_record"), "id") == [(None, "no json"), ("a", None)]
    xz_file(folder / "2.xz", [b'{"id": "b"', b', "score": 1}\n'])
    run()
    run()
    assert rows(spark.read.parquet(out).select("id", "_corrupt_record"), "id") == [(None, "no json"), ("a", None), ("b", None)]
    (folder / "3.xz").write_bytes(b"x")
    with pytest.raises(Exception, match="xz"):
        run()
    assert spark.read.parquet(out).count() == 3


def test_unfinished_artefact_is_made_again(spark, tmp_path):
    path = str(tmp_path / "half")
    spark.range(10).repartition(2).write.parquet(path)
    (tmp_path / "half" / "_SUCCESS").unlink()
    next((tmp_path / "half").glob("part-*.parquet")).unlink()
    assert tables.load_or_compute(spark, path, lambda: spark.range(10)).count() == 10


def test_merged_summary(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "k INT, metric STRING, value DOUBLE")
    new = spark.createDataFrame([(2, "a", 9.0), (3, "b", 4.0)], "k INT, metric STRING, value DOUBLE")
    assert rows(summaries.merged(old, new, ["k"]), "k") == [(1, "a", 1.0), (2, "a", 9.0), (3, "b", 4.0)]
