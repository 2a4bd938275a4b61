"""The API source, plugins as table functions, the job queue, stream progress, seen files and ledgers."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from scriptorium import jobs
from scriptorium.sources import api, plugins
from scriptorium.streaming import ledger, news
from scriptorium.streaming.progress import ProgressLog, progress

# ---------------------------------------------------------------- API


def answer(root, endpoint, data, **query):
    folder = os.path.join(root, endpoint, *(f"{k}={api.hive_name(str(v))}" for k, v in query.items()))
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "part-0"), "w", encoding="utf-8") as f:
        json.dump(data, f)


@pytest.fixture
def served(tmp_path):
    root = str(tmp_path)
    answer(root, "index", {"data": ["a", "b"]}, of="slug")
    for slug, pages in (("a", 20), ("b", 1)):
        for n in range(1, pages + 1):
            chapters = [{"name": f"{slug}{n}.{i}", "url": f"/c/{slug}/{n}/{i}", "vip": i == 2} for i in range(3)]
            if n == 3:
                chapters += [{"name": "again", "url": "/c/a/1/0"}, {"name": "blank", "url": ""}, {"name": None, "url": "http://else/x"}, "no chapter", {"url": None}]
            answer(root, "chapters", {"data": chapters, "total_page": pages}, slug=slug, page=n)
    answer(root, "chapter", {"data": [{"url": "/c/a/1/0", "content": "text"}], "total_page": 1}, slug="a", page=1)
    answer(root, "story", {"data": {"name": "Book A", "author_name": None, "status": "full"}}, slug="a")
    answer(root, "search", {"data": [{"slug": "a", "name": "Book A", "chapter_count": 60, "author_name": "X"}, {"name": "no slug"}], "next": 3}, q="k: w/ö", page=1)
    answer(root, "search", {"data": [{"slug": "b", "status": "full"}], "next": ""}, q="k: w/ö", page=3)
    answer(root, "list", {"data": [{"slug": "b", "img_url": "i.png"}]}, section="hot", page=1)
    return root


@pytest.fixture(scope="module")
def serial(spark):
    spark.dataSource.register(api.ApiSource)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda **options: spark.read.format("serial_api").options(site="http://site", pushdown="true", **options).load()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_api_contents(spark, serial, served):
    toc = serial(root=served, table="toc")
    assert toc.rdd.getNumPartitions() == 4  # 20 pages of eight a task, and one
    rows = api.contents(toc).collect()
    a = sorted((r for r in rows if r["slug"] == "a"), key=lambda r: r["idx"])
    assert [r["idx"] for r in a] == list(range(1, 62)) and len(rows) == 64
    assert (a[0]["title"], a[0]["url"], a[2]["vip"]) == ("a1.0", "http://site/c/a/1/0", True)
    assert [(r["idx"], r["title"]) for r in a if r["url"] == "http://else/x"] == [(10, "Chương 10")]


def test_api_pushdown(serial, served):
    one = serial(root=served, table="toc").where("slug = 'b'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 3
    assert serial(root=served, table="toc").where("slug IN ('b', 'none')").count() == 3
    assert serial(root=served, table="toc", slug="a").where("slug = 'b'").count() == 0
    assert serial(root=served, table="toc").where("slug = 'b' AND pos > 1").count() == 1
    # No answer lists what can be searched for.
    with pytest.raises(Exception, match="name the q"):
        serial(root=served, table="search").count()


def test_api_tables(serial, served):
    found = serial(root=served, table="search").where(F.col("q") == "k: w/ö").orderBy("page").collect()
    assert [tuple(r)[1:] for r in found] == [(1, 0, "a", "Book A", "http://site/a", "X", "", "60 chương"), (3, 0, "b", "b", "http://site/b", "", "", "full")]
    assert [tuple(r) for r in serial(root=served, table="detail", slug="a,none").collect()] == [("a", "Book A", "", "", "full", "")]
    assert [r["cover"] for r in serial(root=served, table="home", section="hot").collect()] == ["i.png"]
    assert [r["body"] for r in serial(root=served, table="chapter", slug="a").collect()] == ["text"]
    with pytest.raises(Exception, match="table must be"):
        serial(root=served, table="other").count()


def test_api_over_http(served):
    """The same answers from a server of this machine's own."""
    import http.server
    import threading
    from urllib.parse import parse_qsl, urlparse

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            raw = api.Transport(served)._stored(url.path.strip("/"), dict(parse_qsl(url.query)))
            self.send_response(200 if raw else 404)
            self.end_headers()
            self.wfile.write(raw or b"")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    reader = api.ApiReader({"root": f"http://127.0.0.1:{server.server_port}", "table": "toc", "slug": "a"})
    assert [len(list(reader.read(p))) for p in reader.partitions()] == [28, 24, 12]
    assert api.Transport(reader.rows.root).get("chapters", slug="nothing", page="1") is None
    server.shutdown()


def test_api_stream(spark, serial, served, tmp_path):
    def run():
        stream = spark.readStream.format("serial_api").options(root=served, slug="a,b", site="http://site").load()
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").groupBy("slug").agg(F.max("page").alias("p"), F.count("*").alias("n")).orderBy("slug").collect()

    assert [tuple(r) for r in run()] == [("a", 19, 61)]  # the last pages may still grow
    answer(served, "chapters", {"data": [{"name": "new", "url": "/n"}], "total_page": 21, "complete": True}, slug="a", page=21)
    answer(served, "chapters", {"data": [{"name": "x", "url": "/x"}], "total_page": 21}, slug="a", page=1)
    answer(served, "chapters", {"data": [{"name": "b", "url": "/b"}], "total_page": 1, "complete": True}, slug="b", page=1)
    assert [tuple(r) for r in run()] == [("a", 21, 65), ("b", 1, 1)]
    assert [tuple(r) for r in run()] == [("a", 21, 65), ("b", 1, 1)]


# ---------------------------------------------------------------- plugins


class Shelf(plugins.Plugin):
    id = "shelf"

    def search(self, html, url):
        return ((x.strip(), f"{url}/{i}") for i, x in enumerate(html.split("|")) if x.strip())


PAGE = "<html><head><title>T - site</title></head><body><h1>[x] My book</h1><p class='author'>Ann</p><a href='/chuong-1'>Chapter 1</a><a href='/about'>About</a><a href='/chuong-2'>Chapter 2</a></body></html>"


def test_plugin_contract(spark):
    generic = plugins.Plugin()
    assert list(generic.book(PAGE, "http://h/b")) == [("My book", "Ann", "", "")]
    assert list(generic.chapters(PAGE, "http://h/b")) == [("Chapter 1", "http://h/chuong-1"), ("Chapter 2", "http://h/chuong-2")]
    assert [x for x, _ in generic.search(PAGE, "http://h/b")] == ["Chapter 1", "About", "Chapter 2"]
    assert list(generic.content("<p>a</p><script>x</script>b<br>c", "")) == [("a",), ("b",), ("c",)]
    for method, names in plugins.METHODS.items():
        assert all(len(row) == len(names) for row in getattr(generic, method)(PAGE, "http://h/b"))
        assert len(list(getattr(generic, method)("", ""))) <= 1

    class Half:
        id = "half"
        book = chapters = content = lambda *a: []

    with pytest.raises(TypeError, match="search"):
        plugins.register(spark, Half)


def test_plugin_functions(spark):
    plugins.register(spark, plugins.Plugin)
    plugins.register(spark, Shelf)
    rows = [(1, "w", PAGE, "http://h/b"), (2, "w", PAGE.replace("chuong-1", "chuong-3"), "http://h/b"), (1, "v", None, None)]
    spark.createDataFrame(rows, "page int, work string, html string, url string").createOrReplaceTempView("fetched")
    got = spark.sql("SELECT f.page, b.title, b.author FROM fetched f, LATERAL generic_page(f.html, f.url, 'book') b WHERE f.work = 'w'").collect()
    assert [tuple(r) for r in got] == [(1, "My book", "Ann"), (2, "My book", "Ann")]
    got = spark.sql("SELECT * FROM generic_works(TABLE(fetched) PARTITION BY (work) ORDER BY (page), 'chapters')").orderBy("idx").collect()
    assert [(r["work"], r["page"], r["idx"], r["url"]) for r in got] == [("w", 1, 1, "http://h/chuong-1"), ("w", 1, 2, "http://h/chuong-2"), ("w", 2, 3, "http://h/chuong-3")]
    assert spark.sql("SELECT * FROM shelf_page('a | | b', 'u', 'search')").collect()[1][1:] == ("b", "u/2")
    for call in ("generic_page('a', 'b', 'other')", "generic_works(TABLE(SELECT 1 AS work), 'book')"):
        with pytest.raises(Exception, match="the method must be|the table lacks"):
            spark.sql(f"SELECT * FROM {call}").collect()


# ---------------------------------------------------------------- jobs


def chapters(n, bad=()):
    return lambda spark: spark.range(n).select(F.col("id").alias("item"), F.when(F.col("id").isin(list(bad)), "empty").alias("error"))


def test_jobs(spark):
    queue = jobs.JobQueue(spark)

    def fails(_):
        raise OSError("no network")

    ids = [queue.submit("a", chapters(10, [2, 5])), queue.submit("b", fails), queue.submit("c", chapters(3), total=4), queue.submit("d", chapters(0))]
    assert [queue.wait(i, 120) for i in ids] == ["done", "failed", "done", "done"]
    rows = {r["title"]: r for r in queue.statuses().collect()}
    assert tuple(rows["a"])[2:6] == ("done", 10, 8, 2) and rows["a"]["percent"] == 80.0
    assert "no network" in rows["b"]["message"] and (rows["c"]["percent"], rows["d"]["percent"]) == (75.0, 0.0)
    assert queue.items(ids[0]).where("error IS NOT NULL").count() == 2
    assert not queue.cancel(ids[0]) and not queue.cancel("none")
    assert queue.clear_ended() == 4 and queue.statuses().count() == 0 and queue.clear_ended() == 0


def test_cancelled_jobs(spark):
    queue = jobs.JobQueue(spark)

    def slow(s):
        def wait(batches):
            for b in batches:
                time.sleep(60)
                yield b

        return s.range(4).repartition(4).mapInPandas(wait, "id long").select(F.col("id").alias("item"), F.lit(None).alias("error"))

    running, waiting, last = queue.submit("slow", slow), queue.submit("waits", chapters(5)), queue.submit("last", chapters(5))
    for _ in range(100):
        if queue._jobs[running].status == "running":
            break
        time.sleep(0.1)
    assert queue._jobs[waiting].status == "waiting"  # one at a time
    began = time.time()
    assert queue.cancel(waiting) and queue.cancel(running)
    assert [queue.wait(i, 50) for i in (running, waiting, last)] == ["cancelled", "cancelled", "done"]
    assert time.time() - began < 45
    assert {r["title"]: r["status"] for r in queue.statuses().collect()} == {"slow": "cancelled", "waits": "cancelled", "last": "done"}


def test_lost_jobs(spark, tmp_path):
    path = f"{tmp_path}/jobs"
    queue = jobs.JobQueue(spark, path)
    done = queue.submit("done", chapters(1))
    queue.wait(done, 60)
    row = ("job-gone-0", "gone", 0, 1, "left", "running", 5, None, None, None, 1.0)
    spark.createDataFrame([row], jobs._STATUS).write.mode("append").parquet(f"{path}/status")
    assert jobs.mark_lost(spark, path, [queue.id]) == 1
    assert {r["title"]: r["status"] for r in jobs.latest(spark, path).collect()} == {"left": "lost", "done": "done"}
    assert jobs.mark_lost(spark, path, []) == 0


# ---------------------------------------------------------------- streams


def files_of(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "watch_id string, url string").coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema("watch_id string, url string").option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_progress(spark, tmp_path):
    stream = files_of(spark, f"{tmp_path}/in", [[("w", str(i)) for i in range(5)], [("w", str(i)) for i in range(7)]])
    with ProgressLog(spark) as log:
        for name in ("one", "two"):
            counts = stream.groupBy("url").count()
            counts.writeStream.queryName(name).outputMode("update").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).foreachBatch(lambda b, i: b.count()).start().awaitTermination()
        with pytest.raises(Exception):

            def breaks(batch, number):
                raise ValueError("broken")

            stream.writeStream.queryName("bad").option("checkpointLocation", f"{tmp_path}/bad").trigger(availableNow=True).foreachBatch(breaks).start().awaitTermination()
    rows = {r["name"]: r for r in progress(log.table()).collect()}
    assert [(rows[n]["batches"], rows[n]["rows_in"], rows[n]["state_rows"], rows[n]["status"]) for n in ("one", "two")] == [(2, 12, 7, "ended")] * 2
    assert rows["bad"]["status"] == "failed" and log.table().where("error LIKE '%broken%'").count() == 1


@pytest.mark.parametrize("breaks_at", ["out", "harvested", None])
def test_unseen_exactly_once(spark, tmp_path, monkeypatch, breaks_at):
    batches = [[("w", "a"), ("w", "b"), ("w", "a"), ("v", "old")], [("w", "b"), ("w", "c"), ("v", "a")]]
    stream = files_of(spark, f"{tmp_path}/in", batches)
    harvested, out = f"{tmp_path}/harvested", f"{tmp_path}/out"
    news.start_harvested(spark.createDataFrame([("v", "old")], "watch_id string, url string"), harvested)
    run = lambda: news.unseen(stream, harvested, out, f"{tmp_path}/at").start().awaitTermination()
    if breaks_at:
        from pyspark.sql.readwriter import DataFrameWriter

        write = DataFrameWriter.parquet

        def once(self, path, *a, **k):
            write(self, path, *a, **k)
            if path.startswith(f"{tmp_path}/{breaks_at}/"):  # the write is there, what comes after it is not
                monkeypatch.setattr(DataFrameWriter, "parquet", write)
                raise OSError("lost")

        monkeypatch.setattr(DataFrameWriter, "parquet", once)
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    run()
    want = [("v", "a"), ("w", "a"), ("w", "b"), ("w", "c")]
    assert sorted((r["watch_id"], r["url"]) for r in spark.read.parquet(out).collect()) == want
    assert sorted((r["watch_id"], r["url"]) for r in news.harvested_files(spark, harvested).collect()) == sorted([*want, ("v", "old")])


def test_unseen_by_two_streams(spark, tmp_path):
    """Another checkpoint counts its batches anew and must not overwrite the first one's."""
    first, second = files_of(spark, f"{tmp_path}/1", [[("w", "a")]]), files_of(spark, f"{tmp_path}/2", [[("w", "a"), ("w", "b")]])
    for i, stream in enumerate((first, second)):
        news.unseen(stream, f"{tmp_path}/h", f"{tmp_path}/o", f"{tmp_path}/at{i}").start().awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(f"{tmp_path}/o").collect()) == ["a", "b"]


# ---------------------------------------------------------------- ledgers


def shortest(lines):
    """A compactor that merges the oldest lines."""
    return [f"merged {sum(int(x.split()[1]) if x.startswith('merged') else 1 for x in lines[:-19])}", *lines[-19:]]


def test_ledger_fold():
    assert ledger.fold_ledger([["a"] * 50], ledger.keep_last) == (["a"] * 50, 0)
    assert ledger.fold_ledger([["a"] * 51], ledger.keep_last) == (["a"] * 30, 1)
    assert ledger.fold_ledger([["a"] * 51, [" ", None, "b"]], lambda x: []) == (["a"] * 51 + ["b"], 0)
    assert ledger.fold_ledger([["a"] * 60], lambda x: x) == (["a"] * 30, 1)

    def fails(lines):
        raise RuntimeError

    assert ledger.fold_ledger([["a"] * 60, ["b"]], fails) == (["a"] * 60 + ["b"], 0)


def test_ledger_stream(spark, tmp_path):
    import random

    rng = random.Random(2)
    turns = [(s, t, [f"{s}.{t}.{i}" for i in range(rng.randint(0, 6))] or None) for s in ("p", "q", "r") for t in range(40)]
    path = f"{tmp_path}/in"
    for i in range(4):
        part = [x for x in turns if x[1] // 10 == i]
        rng.shuffle(part)
        spark.createDataFrame(part, "session string, turn int, lines array<string>").coalesce(2).write.parquet(f"{path}/{i}")
    for i in range(4):  # a run for each folder, so that batches are in order and the state is read back
        stream = spark.readStream.schema("session string, turn int, lines array<string>").parquet(f"{path}/[0-{i}]")
        out = ledger.ledger_stream(stream, shortest)
        out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out")).start().awaitTermination()
    got = {r["session"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    for s in ("p", "q", "r"):
        lines, n = ledger.fold_ledger([x[2] or [] for x in turns if x[0] == s], shortest)
        assert (got[s]["lines"], got[s]["compactions"], got[s]["turns"]) == (lines, n, 40) and n > 1


def test_feeds_share_files(spark, data, monkeypatch):
    """Feeds are rows of files: files, which take longer to open than feeds to read, are as many as tasks, not as feeds."""
    from scriptorium.plans import services

    at = []
    monkeypatch.setattr(services, "new_path", lambda s, name, f=services.new_path: at.append(f(s, name)) or at[-1])
    feeds = services._user_feeds(spark, data)
    n = feeds.select("id").distinct().count()
    assert n == feeds.count() > 8
    assert spark.read.format("binaryFile").load(at[-1]).count() <= 8
