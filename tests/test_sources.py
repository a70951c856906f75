"""Archives, directories, history files and streams in a scratch folder."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from treeloom.fixed_values import ENGINE_COLUMN, HISTORY_DDL
from treeloom.operators import files, json_trees
from treeloom.session import unless_set
from treeloom.sinks import writers
from treeloom.jobs import analyse
from treeloom.jobs.analyse import Analysis
from treeloom.operators.dispatch import Dialects, json_results, line_results
from treeloom.sources import archives, trees, walk
from treeloom.sources.layout import dealt_by_bytes
from treeloom.streaming import ingest


def make_zip(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, data, method in entries:
            z.writestr(zipfile.ZipInfo(name), data, method)


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    make_zip(folder / "one.zip", [
        ("src/a.js", "old", zipfile.ZIP_STORED), ("src/a.js", "let a\n", zipfile.ZIP_DEFLATED),
        ("node_modules/x.js", "no", zipfile.ZIP_DEFLATED), ("src/bad.py", b"\xff\xfeok", zipfile.ZIP_STORED),
        ("empty/", "", zipfile.ZIP_STORED), ("dist", "no", zipfile.ZIP_STORED), ("l.c", "int x;" * 50, zipfile.ZIP_LZMA)])
    (folder / "broken.zip").write_bytes(b"this is no zip")
    return str(folder)


def test_archive_scan(spark, landing):
    rows = {(r.repo, r.file_path): (r.content, r.status) for r in archives.archive_to_files(archives.archive_files(spark, landing)).collect()}
    assert rows["one", "src/a.js"] == ("let a\n", "ok")
    assert rows["one", "src/bad.py"] == ("��ok", "ok")
    assert rows["one", "l.c"] == ("int x;" * 50, "ok")
    assert rows["broken", None][1] == "error"
    assert len(rows) == 4


def test_archive_scan_filters_names_before_reading(spark, landing):
    found = archives.archive_to_files(archives.archive_files(spark, landing), [".js"])
    assert {r.file_path for r in found.filter("status = 'ok'").collect()} == {"src/a.js"}


def test_archive_listing_reads_no_contents(spark, landing):
    plan = archives.archive_files(spark, landing)._jdf.queryExecution().toString()
    assert "content" not in plan.split("Physical Plan")[1]


def test_empty_directories_are_seen(spark, landing):
    entries = archives.archive_entries(archives.archive_files(spark, landing))
    assert [tuple(r) for r in archives.empty_directories(entries).collect()] == [("one", "empty")]


def test_latest_archive_per_repository(spark, tmp_path):
    for day, age in (("d1", 100), ("d2", 50)):
        os.makedirs(tmp_path / day)
        make_zip(tmp_path / day / "r.zip", [("a.py", day, zipfile.ZIP_STORED)])
        stat = os.stat(tmp_path / day / "r.zip")
        os.utime(tmp_path / day / "r.zip", (stat.st_atime, stat.st_mtime - age))
    newest = archives.latest_archives(archives.archive_files(spark, str(tmp_path)))
    assert [(r.repo, r.path.split("/")[-2]) for r in newest.collect()] == [("r", "d2")]


def test_directory_walk(spark, tmp_path):
    root = tmp_path / "dist"  # the root's own name is never pruned
    for name, data in {"a.py": "x", "lib/b.py": "y\n", "node_modules/c.py": "no", "lib/dist": "no", "d.txt": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(data)
    (root / "e.py").write_bytes(b"\xffz")
    rows = {r.file_path: r.content for r in trees.directory_files(spark, str(root), "r", [".py"]).collect()}
    assert rows == {"a.py": "x", "lib/b.py": "y\n", "e.py": "�z"}


def records(spark):
    df = spark.createDataFrame([("generic", 'a,"b', ".x", 3), ("generic", 'a,"b', "java", 4), ("native", "c", "java", 1)],
                               f"{ENGINE_COLUMN} string, repo string, language string, loc bigint")
    measured = df.selectExpr("*", "loc * 2 nodes", "2 max_depth", "loc * 1000000L parse_ns", "timestamp'2024-01-01 00:00:00.1239' ts",
                             "9000000L total_ns", "1048576L rss_bytes", "524288L heap_bytes")
    return files.run_records(measured, [ENGINE_COLUMN, "repo"])


def test_run_and_history_files(spark, tmp_path):
    runs, history = str(tmp_path / "runs"), str(tmp_path / "history")
    made = records(spark)
    for _ in range(2):  # a replayed batch replaces itself
        writers.write_runs(made, runs, batch_id=0)
        writers.write_history(made, history, batch_id=0)
    back = {r.repo: r for r in trees.read_runs(spark, runs).collect()}
    assert back['a,"b'].languages["java"].loc == 4 and back['a,"b'].loc == 7 and back["c"].timestamp == "2024-01-01T00:00:00.123Z"
    (tmp_path / "history" / "old.csv").write_text(",".join(c.split()[0] for c in HISTORY_DDL.split(", ")) + "\n\n"
                                                    "2023-01-01T00:00:00.000Z,generic,z,java,1,1,1,1,0.1,0.2,1,1\n")
    lines = trees.read_history(spark, history).orderBy("timestamp", "repo", "language").collect()
    assert [(r.repo, r.language, r.parse_sec, r.total_sec) for r in lines] == [
        ("z", "java", 0.1, 0.2), ('a,"b', ".x", 0.003, 0.009), ('a,"b', "java", 0.004, 0.009), ("c", "java", 0.001, 0.009)]
    assert trees.history_head(trees.read_history(spark, history), 1).first().repo == "z"


def test_snapshot_round_trip(spark, tmp_path):
    dump = '{"type":"a","isNamed":true,"children":[{"type":"b","text":"x"}]}'
    df = spark.createDataFrame([("r", "f", dump)], "repo string, file_path string, content string")
    nodes = json_trees.json_nodes(json_trees.parse_or_raw(df)).withColumn("engine", F.lit("generic"))
    writers.write_snapshot(nodes, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(back.select(nodes.columns).collect(), key=str) == sorted(nodes.collect(), key=str)


def test_snapshots_hold_numbers_as_differences(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.createDataFrame([("r", f"f{i}", '{"type":"a","children":[{"type":"b","text":"x"},{"type":"c"}]}') for i in range(50)], "repo string, file_path string, content string")
    nodes = json_trees.json_nodes(json_trees.parse_or_raw(df)).withColumn("engine", F.lit("generic"))
    writers.write_snapshot(nodes, str(tmp_path / "s"))
    part = pq.ParquetFile(next((tmp_path / "s").rglob("*.parquet"))).metadata.row_group(0)
    kept = {(c := part.column(i)).path_in_schema: c for i in range(part.num_columns)}
    assert {c.compression for c in kept.values()} == {"ZSTD"}
    assert "DELTA_BINARY_PACKED" in kept["node_id"].encodings and "RLE_DICTIONARY" in kept["kind"].encodings
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(back.select(nodes.columns).collect(), key=str) == sorted(nodes.collect(), key=str)


def test_each_archive_is_ingested_once(spark, landing, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def summarise(batch):
        return archives.archive_to_files(batch).groupBy("repo", "status").agg(F.count("*").alias("files"))

    def seen():
        return sorted(tuple(r) for r in spark.read.parquet(out).select("repo", "status", "files").collect())

    ingest.ingest_archives(spark, landing, out, state, summarise)
    first = seen()
    assert first == [("broken", "error", 1), ("one", "ok", 3)]
    ingest.ingest_archives(spark, landing, out, state, summarise)
    assert seen() == first
    make_zip(f"{landing}/two.zip", [("b.py", "x", zipfile.ZIP_STORED)])
    ingest.ingest_archives(spark, landing, out, state, summarise)
    assert seen() == [*first, ("two", "ok", 1)]


def test_damaged_encrypted_and_vanished_entries(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as archive:
        archive.writestr("good.js", "fine")
        archive.writestr("bad.js", "damaged")
        archive.writestr("locked.js", "secret")
    data = path.read_bytes().replace(b"damaged", b"dAmaged")
    path.write_bytes(data)
    entries = archives.archive_entries(archives.archive_files(spark, str(tmp_path)))
    flagged = entries.withColumn("flags", F.when(F.col("entry_path") == "locked.js", 1).otherwise(F.col("flags")))
    read = {r.entry_path: (r.content, r.error) for r in archives.entry_contents(flagged).collect()}
    assert read["good.js"] == ("fine", None)
    assert "damaged" in read["bad.js"][1] and "encrypted" in read["locked.js"][1]
    gone = entries.withColumn("archive", F.concat("archive", F.lit(".gone")))
    assert all(r.content is None and r.error for r in archives.entry_contents(gone).collect())


def test_tasks_of_equal_bytes(spark):
    """One long list of entries, one of them large: no task has more than its mark and a row."""
    rows = [(f"a{i // 400}", i, 5_000_000 if i == 777 else 100 + i % 50) for i in range(2000)]
    df = spark.createDataFrame(rows, "archive string, offset bigint, packed bigint")
    dealt = dealt_by_bytes(df, "packed", ["archive", "offset"], 20_000)
    sizes = dealt.groupBy(F.spark_partition_id().alias("task")).agg(F.sum("packed").alias("bytes"), F.max("packed").alias("most"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in sizes) == 2000 and all(r.bytes - r.most < 20_000 for r in sizes)
    small = [r for r in sizes if r.most < 1000]
    mean = sum(r.bytes for r in small) / len(small)
    assert max(r.bytes for r in small) < 2 * mean
    # The number of tasks follows the bytes.
    assert dealt_by_bytes(df, "packed", ["archive", "offset"], 200_000).rdd.getNumPartitions() < dealt.rdd.getNumPartitions()
    assert dealt_by_bytes(df.limit(0), "packed", ["archive", "offset"], 20_000).count() == 0


def test_walk_sees_directories(spark, tmp_path):
    root = tmp_path / "dist"  # the root's own name is never pruned
    for name in ("a.py", "lib/b.py", "node_modules/c.py", "lib/dist", "deep/er/and/e.txt", "bare/.git/x"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"text of {name}")
    (root / "hollow/inner").mkdir(parents=True)
    (root / "bad.py").write_bytes(b"\xffz")
    walked = walk.walk(spark, str(root))
    dirs = {r.path: r.entries for r in walked.filter("is_dir").collect()}
    assert dirs == {"lib": 1, "deep": 1, "deep/er": 1, "deep/er/and": 1, "bare": 0, "hollow": 1, "hollow/inner": 0}
    assert {r.dir_path for r in walk.empty_directories(walked).collect()} == {"bare", "hollow/inner"}
    found = {r.path: r.content for r in walk.contents(walked, str(root)).collect()}
    assert found == {"a.py": "text of a.py", "lib/b.py": "text of lib/b.py", "deep/er/and/e.txt": "text of deep/er/and/e.txt", "bad.py": "\ufffdz"}
    assert {r.path for r in walk.contents(walked, str(root), [".txt"]).collect()} == {"deep/er/and/e.txt"}
    (root / "a.py").unlink()
    gone = {r.path: r.error for r in walk.contents(walked, str(root)).collect()}
    assert gone["a.py"].startswith("FileNotFoundError") and gone["bad.py"] is None
    assert walk.walk(spark, str(root / "hollow" / "inner")).count() == 0


def test_written_files_come_back(spark, tmp_path):
    rows = [("a/b.txt", "one\ntwo"), ("a/empty.txt", ""), ("hollow", None)]
    df = spark.createDataFrame(rows, "file_path string, content string")
    for _ in range(2):
        assert {r.file_path: r.bytes for r in writers.write_files(df, str(tmp_path / "out")).collect()} == {"a/b.txt": 7, "a/empty.txt": 0, "hollow": 0}
    walked = walk.walk(spark, str(tmp_path / "out"))
    assert {r.path: r.content for r in walk.contents(walked, str(tmp_path / "out")).collect()} == {"a/b.txt": "one\ntwo", "a/empty.txt": ""}
    writers.write_dumps(df.withColumn("language", F.lit("x")), str(tmp_path / "dumps"))
    assert {r.file_path: r.content for r in trees.read_dumps(spark, str(tmp_path / "dumps")).collect()} == dict(rows)


def test_newest_archive_replaces_the_older(spark, tmp_path):
    landing, out, state = str(tmp_path / "landing"), str(tmp_path / "out"), str(tmp_path / "state")

    def upload(day, name, age, *entries):
        os.makedirs(f"{landing}/{day}", exist_ok=True)
        path = f"{landing}/{day}/{name}.zip"
        make_zip(path, [(e, "x", zipfile.ZIP_STORED) for e in entries])
        stat = os.stat(path)
        os.utime(path, (stat.st_atime, stat.st_mtime - age))

    def summarise(batch):
        return archives.archive_to_files(batch).groupBy("repo").agg(F.count("*").alias("files"))

    def held():
        ingest.ingest_newest(spark, landing, out, state, summarise)
        return {r.repo: r.files for r in ingest.read_newest(spark, out).select("repo", "files").collect()}

    upload("d1", "one", 1000, "a.py", "b.py")
    upload("d1", "two", 1000, "a.py")
    assert held() == {"one": 2, "two": 1}
    assert held() == {"one": 2, "two": 1}
    upload("d2", "one", 500, "a.py", "b.py", "c.py")
    assert held() == {"one": 3, "two": 1}
    # An older one that arrives late changes nothing; one without files leaves none.
    upload("d3", "one", 900, "z.py")
    upload("d3", "two", 100, "dist/a.py")
    assert held() == {"one": 3}


def test_analysis_counts_every_file_once(spark, landing):
    make_zip(landing + "/two.zip", [("t.json", '{"type":"a","children":[{"type":"b"}]}', zipfile.ZIP_STORED), ("u.json", "broken", zipfile.ZIP_STORED), ("e.py", "", zipfile.ZIP_STORED)])

    def measure(found):
        return found.selectExpr("*", "timestamp'2024-01-01' ts", "2000000L parse_ns", "5000000L total_ns", "1048576L rss_bytes", "0L heap_bytes")

    dialects = Dialects().register("lines", [".js", ".py"], line_results).register("json", [".json"], json_results())
    job = Analysis(landing + "-job", "generic", dialects, measure)
    for _ in range(2):
        job.run(archives.archive_files(spark, landing), 7)
    found = {(r.repo, r.file_path): (r.status, r.loc, r.nodes, r.max_depth) for r in job.files(spark).collect()}
    assert found == {
        ("one", "src/a.js"): ("ok", 2, 6, 3), ("one", "src/bad.py"): ("ok", 1, 3, 3), ("two", "t.json"): ("ok", 1, 2, 2),
        ("two", "u.json"): ("error", 1, 0, 0), ("two", "e.py"): ("ok", 0, 1, 1)}
    lines = {(r.repo, r.language): (r.files, r.loc, r.nodes, r.parse_sec) for r in trees.read_history(spark, job.folder("history")).collect()}
    assert lines == {("one", "javascript"): (1, 2, 6, 0.002), ("one", "python"): (1, 1, 3, 0.002), ("two", ".json"): (2, 2, 2, 0.002), ("two", "python"): (1, 0, 1, 0.002)}
    assert trees.read_runs(spark, job.folder("runs")).count() == 2


def test_nodes_are_written_where_they_are_built(spark, tmp_path, monkeypatch):
    """Nodes are many times their files: neither shuffled nor sorted by folder, but where a task
    meets more repositories than it may keep open."""
    landing = tmp_path / "landing"
    landing.mkdir()
    for i in range(7):
        make_zip(landing / f"r{i}.zip", [(f"{k}.py", "x y\n" * (i + k), zipfile.ZIP_DEFLATED) for k in range(3)])
    measure = lambda found: found.selectExpr("*", "timestamp'2024-01-01' ts", "1L parse_ns", "1L total_ns", "1L rss_bytes", "1L heap_bytes")
    limits = dict(analyse.NODES_SETTINGS)
    found, plans = [], []

    def write(nodes, *rest, **more):
        writers.write_snapshot(nodes, *rest, **more)
        done = spark._jsparkSession.sharedState().statusStore().executionsList()
        plans.append(done.last().physicalPlanDescription())

    monkeypatch.setattr(analyse, "write_snapshot", write)
    for name, most in (("many", limits["spark.sql.maxConcurrentOutputFileWriters"]), ("two", "2")):
        monkeypatch.setattr(analyse, "NODES_SETTINGS", limits | {"spark.sql.maxConcurrentOutputFileWriters": most})
        job = Analysis(str(tmp_path / name), "generic", Dialects().register("lines", [".py"], line_results), measure)
        job.run(archives.archive_files(spark, str(landing)), 0)
        nodes = spark.read.parquet(job.folder("nodes"))
        assert len(nodes.inputFiles()) == 7
        found.append(sorted(nodes.select("repo", "file_path", "node_id", "parent_id", "text", "start_off", "status").collect(), key=str))
    assert all("batch_id=0" in p and "Exchange" not in p and "Sort" not in p for p in plans)
    assert found[0] == found[1] and len({(r.repo, r.file_path) for r in found[0]}) == 21
    assert all(spark.conf.get(key, None) is None for key in limits)


def test_a_large_file_of_the_table_is_shared_by_tasks(spark, tmp_path):
    import random

    numbers = random.Random(1)
    landing = tmp_path / "landing"
    landing.mkdir()
    make_zip(landing / "r.zip", [(f"{i}.py", f"{numbers.getrandbits(80_000):x}", zipfile.ZIP_STORED) for i in range(800)])
    measure = lambda found: found.selectExpr("*", "timestamp'2024-01-01' ts", "1L parse_ns", "1L total_ns", "1L rss_bytes", "1L heap_bytes")
    job = Analysis(str(tmp_path / "job"), "generic", Dialects().register("lines", [".py"], line_results), measure)
    found = job._files(spark, archives.archive_files(spark, str(landing)), 0)
    assert len(found.inputFiles()) == 1 and found.count() == 800
    with unless_set(spark, analyse.NODES_SETTINGS):
        held = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 2 and max(held) < 400


def test_small_files_and_directories_share_a_batch(tmp_path):
    """A batch a file or a directory costs more than reading it."""
    import pandas as pd

    names = [f"d{i}" for i in range(300)]
    for name in names:
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.py").write_text(name)
    listed = list(walk._list(str(tmp_path))(iter([pd.DataFrame({"path": ["", *names, "gone"]})])))
    assert len(listed) == 1 and len(listed[0]) == 300 + 1 + 300 * 2 + 1 and listed[0]["error"].notna().sum() == 1
    read = list(walk._read(str(tmp_path))(iter([pd.DataFrame({"path": [f"{n}/a.py" for n in names]})])))
    assert len(read) == 1 and list(read[0]["content"]) == names


def test_only_the_folders_of_a_batch_are_opened(spark, tmp_path):
    landing, out, state = str(tmp_path / "landing"), str(tmp_path / "out"), str(tmp_path / "state")
    os.makedirs(landing)
    for name in ("7", "007", "a b=c", "other"):
        make_zip(f"{landing}/{name}.zip", [("a.py", "x", zipfile.ZIP_STORED)])
    summarise = lambda batch: archives.archive_to_files(batch).groupBy("repo").agg(F.count("*").alias("files"))
    ingest.ingest_newest(spark, landing, out, state, summarise)
    held = ingest._stamps(spark, out, ["007", "a b=c", "unknown"])
    assert {r.repo: r._held.path.rsplit("/", 1)[-1] for r in held.collect()} == {"007": "007.zip", "a b=c": "a b=c.zip"}
    assert len({f.rsplit("/", 2)[-2] for f in held.inputFiles()}) == 2
    assert ingest._stamps(spark, out, ["unknown"]) is None
    assert ingest._stamps(spark, str(tmp_path / "nothing"), ["007"]) is None
    # A repository's rows and mark are one file.
    assert sum(len(list(d.glob("*.parquet"))) for d in (tmp_path / "out").iterdir() if d.is_dir()) == 4


def test_a_listing_is_read_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    folder = str(seen)

    def listed(batches):
        import tempfile

        import pandas as pd

        for _ in batches:
            tempfile.mkstemp(dir=folder)
            yield pd.DataFrame([("gone.zip", "a", 0, False, None, None, None, None, None, None, "unread")], columns=[c.split()[0] for c in archives.ENTRY_DDL.split(", ")])

    entries = spark.range(0, 1, 1, 1).mapInPandas(listed, archives.ENTRY_DDL)
    assert [r.error for r in archives.entry_contents(entries).collect()] == ["unread"]
    assert len(list(seen.iterdir())) == 1


def test_small_dumps_share_a_task(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"d {i}%.txt").write_text(f"A: '{i}'\n  B: 'é'\n")
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "empty").write_text("")
    (tmp_path / "folder").mkdir()
    found = trees.text_dumps(spark, str(tmp_path))
    got = {r.file_path.rsplit("/", 1)[-1]: r.content for r in found.collect()}
    assert got == {f"d {i}%.txt": f"A: '{i}'\n  B: 'é'\n" for i in range(200)} | {"empty": ""}
    assert found.rdd.getNumPartitions() == 1
    with pytest.raises(FileNotFoundError):
        trees.text_dumps(spark, str(tmp_path / "nowhere"))
