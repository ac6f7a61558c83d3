"""Discovery, the two commands, sinks, exit codes, streams, preparation of text."""

import hashlib
import json
import os
import random
import subprocess
import sys
from types import SimpleNamespace

import pytest
import tessitura.sources.samples as a
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessitura import queries as registry
from tessitura.__main__ import main
from tessitura.functions import interpret, text
from tessitura.operators.catalog import frame_catalog
from tessitura.operators.predicate import compiled
from tessitura.operators.run import choice, json_array, last_warnings, suppressed, then
from tessitura.sources.discover import PathError, discovered, extension, resolve, walked_frame
from tessitura.streaming import arriving, counted


@pytest.fixture(scope="module")
def music(tmp_path_factory):
    top = tmp_path_factory.mktemp("music")
    (top / "sub").mkdir()
    (top / "good.mp3").write_bytes(a.id3v2(a.text_frame("TPE1", "Motörhead"), a.text_frame("TRCK", "x")) + a.mp3_frames(60))
    (top / "sub" / "voice.FLAC").write_bytes(a.flac(5, "ARTIST=Nina"))
    (top / "noise.mp3").write_bytes(b"no audio here" * 9)
    (top / "notes.txt").write_bytes(b"x")
    os.symlink(top, top / "sub" / "back")
    return str(top)


def names(found):
    return sorted(os.path.basename(f) for f in found.files)


def test_discovery(music):
    assert names(discovered([music])) == ["good.mp3", "noise.mp3", "voice.FLAC"]
    assert names(discovered([music + "/*.mp3", music + "/good.mp3"])) == ["good.mp3", "noise.mp3"]
    assert names(discovered([music + "/none*"])) == [] and names(discovered([music + "/notes.txt"])) == []
    assert names(discovered([music + "/su?"]))[-1] == "voice.FLAC"
    with pytest.raises(PathError) as e:
        resolve([music + "/missing", music + "/*a*", music + "/s*/x.mp3"])
    assert len(e.value.problems) == 3


def test_what_holds_a_wildcard_is_a_pattern(tmp_path):
    for name in ("a*b.mp3", "axb.mp3", "q?.mp3", "qz.mp3"):
        (tmp_path / name).write_bytes(b"x")
    assert names(discovered([f"{tmp_path}/a*b.mp3"])) == ["a*b.mp3", "axb.mp3"] and names(discovered([f"{tmp_path}/q?.mp3"])) == ["q?.mp3", "qz.mp3"]
    assert discovered([f"{tmp_path}/missing/*.mp3", f"{tmp_path}/missing/?"]).files == []
    with pytest.raises(PathError) as e:
        resolve([f"{tmp_path}/x*/*", f"{tmp_path}/a**b", f"{tmp_path}/nothing.mp3"])
    assert len(e.value.problems) == 3


def test_folders_that_cannot_be_listed(music, monkeypatch):
    """Before the run they are rejected; met on a walk they are a warning, and the walk goes on."""
    real = os.scandir

    def scandir(path):
        if os.path.basename(path) == "sub":
            raise PermissionError(13, "Permission denied", path)
        return real(path)

    monkeypatch.setattr(os, "scandir", scandir)
    found = discovered([music])
    assert names(found) == ["good.mp3", "noise.mp3"] and [(os.path.basename(p), "Permission" in m) for p, m in found.warnings] == [("sub", True)]
    for spec in (f"{music}/sub", f"{music}/sub/*"):
        with pytest.raises(PathError):
            resolve([spec])


def test_executors_walk_like_the_driver(spark, music, tmp_path):
    os.symlink(music, tmp_path / "in")
    (tmp_path / "own.mp3").write_bytes(b"x")
    os.symlink(tmp_path, tmp_path / "self")
    for roots in ([music], [str(tmp_path)], [music, str(tmp_path), music], []):
        got = [r["path"] for r in walked_frame(spark, roots, per_task=1).collect()]
        assert sorted(got) == sorted(discovered(roots).files)


def test_links_of_any_depth(tmp_path):
    """Folders that link to each other are walked until a link leads back; chains longer than the system follows just end."""
    for i in range(45):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / f"f{i}.mp3").write_bytes(b"x")
        os.symlink(tmp_path / f"d{(i + 1) % 45}", tmp_path / f"d{i}" / "l")
    found = discovered([f"{tmp_path}/d0"])
    assert {os.path.basename(f) for f in found.files} >= {f"f{i}.mp3" for i in range(40)}


def test_files_of_a_store_are_read_by_ranges(tmp_path, monkeypatch):
    from pyarrow import fs
    from tessitura.sources import audio

    (tmp_path / "big.mp3").write_bytes(a.id3v2(a.text_frame("TPE1", "x")) + a.xing_frame(2000, 2001 * 417) + a.mp3_frames(2000))
    store = SimpleNamespace(FileSystem=SimpleNamespace(from_uri=lambda uri: (fs.LocalFileSystem(), uri.removeprefix("store://"))))
    monkeypatch.setattr(audio, "fs", store)
    r, pull, close = audio.opened(f"store://{tmp_path}/big.mp3")
    found = audio.analysed(r, "mp3")
    assert r.length == (tmp_path / "big.mp3").stat().st_size and r.pulled <= 2 * 64 * 1024 and found.playing.basis == "counted"
    assert len(audio.digest(found, pull)) == 32
    close()


def test_workers_get_the_package(tmp_path):
    """A cluster of other processes that don't know this folder."""
    script = tmp_path / "job.py"
    script.write_text(
        f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
import tessitura
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "600m").getOrCreate()
tessitura.ship(spark)
tessitura.ship(spark)
from tessitura.operators.run import judged
import tessitura.sources.samples as made
files = spark.createDataFrame([("/x/a.mp3", bytearray(made.mp3_frames(30)))], "path string, content binary")
print("HASH", judged(files, None, None, "md5").first()["hash"])
"""
    )
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env={**env, "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}, capture_output=True, text=True, timeout=300)
    assert f"HASH {hashlib.md5(a.mp3_frames(30)).hexdigest()}" in out.stdout, out.stderr[-2000:]
    assert [extension(n) for n in ("a.mp3", ".mp3", "a.", "a", "a.b.c")] == ["mp3", None, None, None, "c"]


def test_list_and_hash_commands(spark, music, capsys):
    assert main(["list", music, "--filter", 'artist == "motorhead"'], spark) == 0
    out = capsys.readouterr()
    assert out.out.strip().endswith("good.mp3") and "file: " in out.err
    assert main(["list", music, "--filter", "artist =="], spark) == 2 and "unexpected-end" in capsys.readouterr().err
    assert main(["list", music, "--filter", 'file::extension == "flac"', "--strict"], spark) == 0
    assert main(["list", music, "--filter", "track > 1", "--strict"], spark) == 13
    assert main(["list", music, "--filter", "track > 1", "--strict", "--no-warn=file"], spark) == 11
    assert main(["list", music, "--filter", "track > 1", "--strict", "--no-warn=file,unanswered"], spark) == 10
    assert main(["list", music, "--filter", "track > 1", "--strict", "--no-warn=all"], spark) == 20
    assert main(["list", music + "/zzz*", "--strict"], spark) == 21
    capsys.readouterr()
    assert main(["hash", music, "--format", "JSON", "-a", "SHA1"], spark) == 0
    rows = {os.path.basename(r["file"]): r for r in json.loads(capsys.readouterr().out)}
    assert rows["noise.mp3"]["hash"] is None and len(rows["good.mp3"]["hash"]) == 40 and rows["good.mp3"]["algo"] == "sha1"
    assert main(["hash", music], spark) == 0
    assert any(line.endswith(" md5 -") for line in capsys.readouterr().out.splitlines())


def test_json_of_nothing_and_options(spark):
    assert "".join(json_array(spark.createDataFrame([], "path string, hash string"))) == "[]\n"
    assert choice("", ("plain", "json")) == "plain" and choice(" Json", ("plain", "json")) == "json"
    assert suppressed("data, file") == {"data", "file"}
    assert suppressed(None) == frozenset() and suppressed("all") == suppressed("  ") == {"data", "file", "incomplete", "unanswered"}
    for bad in (lambda: choice("xml", ("plain",)), lambda: choice("SHA-1", ("md5", "sha1")), lambda: choice("pl-ain", ("plain",)), lambda: suppressed("x"), lambda: suppressed(""), lambda: suppressed("data,,file")):
        with pytest.raises(ValueError):
            bad()


def test_last_warnings_say_how_many():
    said = lambda u, e, i=0, o=0, silent=(): [m for _, m in last_warnings({"unanswered": u, "examined": e, "incomplete": i, "opened": o}, silent)]
    assert said(0, 5) == [] and said(1, 1) == ["the only examined file has no answer and is left out"]
    assert said(3, 3) == ["all 3 examined files have no answer and are left out"] and said(1, 5) == ["1 of 5 examined files has no answer and is left out"]
    assert said(2, 5, 2, 4) == ["2 of 5 examined files have no answer and are left out", "2 of 4 opened files were read in part"]
    assert said(2, 5, 1, 1, ["unanswered"]) == ["the only opened file was read in part"]


def test_stages_follow_each_other(spark):
    df = spark.range(5)
    assert then()(df).count() == 5 and then(lambda d: d.filter("id > 1"), lambda d: d.filter("id < 4"))(df).count() == 2


def test_streams(spark, music, tmp_path):
    (tmp_path / "box" / "deep").mkdir(parents=True)
    for name in ("good.mp3", "noise.mp3"):
        (tmp_path / "box" / "deep" / name).write_bytes(open(f"{music}/{name}", "rb").read())
    q = arriving(spark, str(tmp_path / "box"), 'artist == "motorhead"').writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "a")).start()
    q.awaitTermination(60)
    assert [r["path"].rpartition("/")[2] for r in spark.table("arrived").collect()] == ["good.mp3"]
    spark.range(100).selectExpr("id", "timestamp_seconds(id * 60) AS ts", "CAST(NULLIF(id % 10, 3) AS int) AS n").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, n int").parquet(str(tmp_path / "in"))
    names_ = frame_catalog(stream, {"n": ("number", "1..1")})
    q = counted(stream, compiled("n > 5", names_), "ts").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "b")).start()
    q.awaitTermination(60)
    total = spark.table("counted").agg(F.sum("examined"), F.sum("matched"), F.sum("unanswered")).first()
    assert tuple(total) == (100, 40, 10)


def test_interpretation():
    assert [interpret.year(x) for x in ("1999", "2001-02-29", "0000", " 2000-02-29T01 ")] == [1999, None, None, 2000]
    assert interpret.genres("(67)Psychadelic/(4)(5)Odd") == ["Psychedelic", "Disco", "Funk", "Odd"] and len(interpret.GENRES) == 148


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_preparation_is_total(value):
    text.normalized(value)
    text.literal(value)


def test_jvm_preparation_equals_python(spark):
    rows = [chr(c) * 2 + "x" for c in range(1, 0x530)] + ["Crème Brûlée", "ガンダム", "ﬁ", "Ǆ", "a̋", "日本", "𝔘ber"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = df.select("t", text.prepare(F.col("t"), False, False).alias("a"), text.prepare(F.col("t"), True, False).alias("b"), text.prepare(F.array("t"), False, True)[0].alias("c")).collect()
    for r in got:
        assert (r["a"], r["b"], r["c"]) == (text.normalized(r["t"]), text.literal(r["t"]), text.normalized(r["t"])), r["t"]


def test_all_preparations_agree(spark):
    """Generated JVM code, the Arrow UDF for sessions without a JVM, and the Python rules."""
    rng = random.Random(5)
    pools = [[chr(c) for c in range(0x20, 0x250)], [chr(c) for c in range(0x300, 0x600)], [chr(c) for c in range(0x1E00, 0x2100)], [chr(c) for c in range(0x3000, 0x3100)], list("ёЁй\u0308\u0301\u00ad\u200d\ufe0fﬁǅϓΐ한ᄒ𝔘ẞςΣıİᲀ")]
    texts = ["".join(rng.choices(rng.choice(pools), k=rng.randrange(0, 12))) for _ in range(3000)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("bag", F.array("t", F.lit("Ä"), F.lit(None)))
    for literally in (False, True):
        got = df.select("t", text.prepare(F.col("t"), literally, False).alias("a"), text._udf(literally, False)(F.col("t")).alias("b"), text.prepare(F.col("bag"), literally, True).alias("c"), text._udf(literally, True)(F.col("bag")).alias("d")).collect()
        for r in got:
            want = None if r["t"] is None else text.prepared(r["t"], literally)
            assert r["a"] == r["b"] == want and r["c"] == r["d"] == [want, text.prepared("Ä", literally), None], r["t"]


def test_preparation_runs_in_generated_code(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(text.prepare(F.col("t"), False, False).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_have_sql_and_rows(spark, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(df.columns) > 0 and name in registry.oracle_sql()
