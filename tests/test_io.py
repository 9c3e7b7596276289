from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rosterlake import schemas, sinks, sources
from rosterlake.sources import files, members
from rosterlake.store import Store, StoreBusy, StoreFenced
from rosterlake.streaming import event_stream, sessions, tumbling_counts, upsert_stream


def test_store_scan(spark, tmp_path):
    rows = [{"name": "Ann", "school_domain": "a.edu", "title": "x", "extra": 1}, {"name": "Ann", "school_domain": "A.edu", "title": "y"}, {"name": "Bo"}, {"school_domain": "b.edu"}]
    for body in ({"leads": rows, "count": 4}, rows):
        (tmp_path / "s.json").write_text(json.dumps(body))
        got = sources.build("store", spark, path=str(tmp_path / "s.json"), spec=schemas.person()).collect()
        assert [(r["key"], r["title"]) for r in got] == [("a.edu|ann", "y")]
    (tmp_path / "s.json").write_text("{not json")
    assert files.read_store(spark, str(tmp_path / "s.json"), schemas.person()).count() == 0
    with pytest.raises(ValueError, match="there are .*seeds"):
        sources.build("nope", spark)


def test_seeds_and_saved_pages(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("﻿# list\nhttps://www.B.edu/x  # b\n\na.edu\nB.edu\nnot a host\nc.edu\n")
    got = files.read_seeds(spark, str(tmp_path / "seeds.txt"), first=["c.edu"], limit=3).collect()
    assert [r["domain"] for r in got] == ["c.edu", "b.edu", "a.edu"]
    (tmp_path / "p" / "www.a.edu").mkdir(parents=True)
    (tmp_path / "p" / "www.a.edu" / "1.html").write_bytes(b"<p>caf\xff")
    (tmp_path / "p" / "loose.html").write_text("x")
    got = files.read_saved(spark, str(tmp_path / "p")).collect()
    assert [(r["domain"], r["file"], r["html"]) for r in got] == [("a.edu", "1.html", "<p>caf�")]


def test_sheets(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿School,Level,Conference,State,Team page (link)\nRed College,Junior College,Coast (CCCAA),CA,https://red.edu/x\n,NAIA,,,\nBlue,NCAA Division II,, Texas ,\n")
    rows = files.institution_rows(files.read_sheet(spark, str(tmp_path / "s.csv"))).collect()
    assert [(r["school"], r["association"], r["division"], r["state"], r["athletics_domain"]) for r in rows] == [("Red College", "CCCAA", "CCCAA", "California", "red.edu"), ("Blue", "NCAA", "DII", "Texas", None)]
    cells = spark.createDataFrame([("a", 0, ["x"]), ("a", 1, ["Conference", "State"]), ("a", 2, ["c", "TX", "n/a"]), ("b", 0, ["c", "CA"])], "sheet string, pos int, cells array<string>")
    got = files.positional_sheet(cells, {"state": 1, "other": 2}).collect()
    assert [(r["sheet"], r["state"], r["other"]) for r in got] == [("a", "TX", None)]
    lines = spark.createDataFrame([(0, "h1.edu  # Red College (CA)"), (1, "h2.edu # Red College (ca)"), (2, "bad")], "pos int, value string")
    assert [(r["host"], r["state"]) for r in files.blocked_seeds(lines).collect()] == [("h1.edu", "ca")]


def test_members(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps([{"nameOfficial": "Red", "divisionRoman": "II", "athleticWebUrl": "https://www.Red.com/x", "privateFlag": "Y", "orgId": 5, "memberOrgAddress": {"state": "TX"}}, {"nameOfficial": "Gone", "deactive": "Y"}]))
    got = members.as_institutions(members.read_members(spark, [str(tmp_path / "1.json")])).collect()
    assert [(r["school"], r["division"], r["athletics_domain"], r["privatePublic"], r["state"]) for r in got] == [("Red", "DII", "red.com", "Private (not-for-profit)", "Texas")]
    (tmp_path / "w.txt").write_text("There are 2\n* [[Early]] x in Town\n=== Texas ===\n* [[Red College|Red]] Bears in [[Town, Texas|Town]]\n* [[Red College|Red]] again\n* [http://x ref]\n* Blue Jays in Ville\n=== Ontario ===\n*[[Green#c]] G in Plain Town\n")
    got = members.read_wiki(spark, {"NJCAA DI": str(tmp_path / "w.txt")}).orderBy("pos").collect()
    assert [(r["school"], r["city"], r["state"], r["linked"], r["division"]) for r in got] == [("Red", "Town", "TX", True, "NJCAA"), ("Blue Jays", None, "TX", False, "NJCAA"), ("Green", "Plain Town", "ON", True, "NJCAA")]
    (tmp_path / "n.txt").write_text("NATIONAL ASSOCIATION – KS X\nBaker University* – KS  HAAC\nBaker University - KS HAAC\nX, University of – BC  Odd\nTotal Schools (2)\n")
    got = members.read_member_text(spark, str(tmp_path / "n.txt")).orderBy("pos").collect()
    assert [(r["school"], r["state"], r["conference"]) for r in got] == [("Baker University", "KS", "Heart of America Athletic Conference"), ("University of X", "BC", "Odd")]
    assert members.stated_total(members.line_table(spark, str(tmp_path / "n.txt"))).first()["stated"] == 2


def test_reports(spark, tmp_path):
    for run, body in (("r1", '[{"domain": "a", "status": "ok"}]'), ("r2", '{"sites": [{"domain": "b", "status": "error", "people": 2}]}'), ("r3", "{bad")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "sites.json").write_text(body)
        (tmp_path / run / "meta.json").write_text('{"source": "x"}')
    (tmp_path / "r4").mkdir()
    (tmp_path / "r4" / "meta.json").write_text('{"source": "y"}')
    got = files.read_reports(spark, str(tmp_path)).orderBy("run_id").collect()
    assert [(r["run_id"], r["domain"], r["status"]) for r in got] == [("r1", "a", "ok"), ("r2", "b", "error")]
    assert [(r["run"], r["has_report"]) for r in files.read_metas(spark, str(tmp_path)).collect()] == [("r4", False), ("r3", True), ("r2", True), ("r1", True)]
    assert files.run_id_ok("r1") and not any(map(files.run_id_ok, ("", "../x", "a/b", ".x", "a\\b")))


def _incoming(spark, rows):
    cols = [f.name for f in schemas.PERSON]
    df = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schemas.PERSON)
    return df.withColumn("seq", F.lit(1).cast("long"))


def test_store_versions(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/people", schemas.person())
    a = {"name": "Ann", "school_domain": "a.edu", "emails": ["x@a.edu"], "departed": False}
    assert [r["change"] for r in s.upsert(_incoming(spark, [a])).collect()] == ["new"]
    log = s.upsert(_incoming(spark, [{**a, "emails": ["y@a.edu"]}, {"name": "Bo", "school_domain": "a.edu"}])).collect()
    assert sorted(r["change"] for r in log) == ["new", "updated"] and s.version() == 2
    assert {r["name"]: r["emails"] for r in s.read().collect()}["Ann"] == ["x@a.edu", "y@a.edu"] and s.read(1).count() == 1
    s.upsert(_incoming(spark, [{"name": "Cy", "school_domain": "a.edu"}]), dry_run=True)
    assert s.version() == 2
    with s.lock(), pytest.raises(StoreBusy):
        s.upsert(_incoming(spark, [a]))
    sinks.export(s.read(), f"{tmp_path}/out.csv", ["name", "emails", "departed"], single=True)
    back = {r["name"]: r for r in spark.read.option("header", True).csv(f"{tmp_path}/out.csv").collect()}
    assert back["Ann"]["emails"] == "x@a.edu; y@a.edu" and back["Ann"]["departed"] == "False"


def test_lock_of_a_killed_writer_runs_out(spark, tmp_path):
    """A lock is renewed while its writer lives; one that isn't is taken over, by one of those that wait for it."""
    import time

    s = Store(spark, f"file://{tmp_path}/s", schemas.person())
    s._fs.mkdirs(s._path(s.root))
    s._put(s._path(f"{s.root}/LOCK"), f"someone {time.time() + 60}", False)
    with pytest.raises(StoreBusy), s.lock():
        pass
    s._put(s._path(f"{s.root}/LOCK"), f"someone {time.time() - 1}", True)
    with s.lock(lease=0.6):
        for _ in range(4):  # longer than the lease
            time.sleep(0.3)
            with pytest.raises(StoreBusy), s.lock():
                pass
    assert not s._fs.exists(s._path(f"{s.root}/LOCK"))
    with s.lock():
        pass


def test_writer_that_lost_its_lock_is_fenced(spark, tmp_path):
    """A stalls past its lease, B takes over: A's commit fails, A's exit leaves B's lock alone, and C stays out."""
    import time

    a, b, c = (Store(spark, f"file://{tmp_path}/s", schemas.person()) for _ in range(3))
    row = lambda name: _incoming(spark, [{"name": name, "school_domain": "a.edu"}])
    a.upsert(row("First"))
    held = a.lock(lease=0.2, renew=False)
    mine = held.__enter__()
    time.sleep(0.4)
    with b.lock() as theirs:
        assert theirs == mine + 1
        with pytest.raises(StoreFenced):
            a._write(a.read().withColumn("_change", F.lit("new")), None, a.version() + 1, mine, 4, None)
        held.__exit__(None, None, None)
        with pytest.raises(StoreBusy):
            c.upsert(row("Third"))
        b._write(b.read().withColumn("_change", F.lit("new")), None, b.version() + 1, theirs, 4, None)
    assert b.version() == 2
    with pytest.raises(StoreFenced), c.lock() as now:  # a version can be made once
        c._write(c.read().withColumn("_change", F.lit("new")), None, 2, now, 4, None)
    c.upsert(row("Third"))
    assert sorted(r["name"] for r in c.read().collect()) == ["First", "Third"]


def test_upsert_rewrites_what_it_touches(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", schemas.person(), buckets=8)
    people = [{"name": f"P{i}", "school_domain": "a.edu", "departed": False, "emails": [f"{i}@a.edu"]} for i in range(60)]
    s.upsert(_incoming(spark, people))
    one = s.manifest(1)
    assert len(one["parts"]) == 8 and s.changes() == {"new": 60, "updated": 0, "returned": 0, "departed": 0, "rows": 60}
    files_of = lambda: {p for p in tmp_path.rglob("*.parquet")}
    before = files_of()
    log = s.upsert(_incoming(spark, [{**people[7], "title": "Coach"}])).collect()
    two = s.manifest(2)
    changed = [k for k in two["parts"] if two["parts"][k] != one["parts"][k]]
    assert len(changed) == 1 and len(files_of() - before) == 1 and [tuple(r) for r in log] == [("a.edu|p7", "updated")]
    assert s.changes() == {"new": 0, "updated": 1, "returned": 0, "departed": 0, "rows": 60}
    title = lambda v: {r["name"]: r["title"] for r in s.read(v).collect()}["P7"]
    assert (title(1), title(2)) == (None, "Coach") and s.read().count() == s.read(1).count() == 60
    everyone = people[:30] + [{**people[7], "name": "New"}]
    rosters = spark.createDataFrame([("a.edu", f"a.edu|p{i}") for i in range(40)], "domain string, key string")
    log = {r["key"]: r["change"] for r in s.upsert(_incoming(spark, everyone), rosters=rosters, now="2026-02-03").collect()}
    assert log["a.edu|new"] == "departed" and {k for k, v in log.items() if v == "departed"} == {f"a.edu|p{i}" for i in range(40, 60)} | {"a.edu|new"}
    assert s.changes()["departed"] == 21 and s.read().where("departed").count() == 21
    assert s.vacuum() > 0 and s.read().count() == 61 and s.version() == 3
    with pytest.raises(Exception):
        s.read(1).count()


def test_batch_is_folded_once(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", schemas.person(), buckets=2)
    row = _incoming(spark, [{"name": "Ann", "school_domain": "a.edu"}])
    assert s.upsert(row, batch=("q", 0)).count() == 1
    assert s.upsert(row, batch=("q", 0)).count() == 0 and s.version() == 1
    assert s.upsert(row, batch=("q", 1)).count() == 1 and s.upsert(row, batch=("other", 0)).count() == 1 and s.version() == 3


def test_dry_run_needs_no_lock(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", schemas.person())
    a = {"name": "Ann", "school_domain": "a.edu"}
    s.upsert(_incoming(spark, [a]))
    with s.lock():
        assert [r["change"] for r in s.upsert(_incoming(spark, [{**a, "name": "Bo"}]), dry_run=True).collect()].count("new") == 1
    assert s.version() == 1 and s.describe("2026-01-01").first()["count"] == 1


def test_upsert_marks_who_is_gone(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", schemas.person())
    people = [{"name": f"P{i}", "school_domain": d, "departed": False} for d in ("a.edu", "b.edu") for i in range(6)]
    s.upsert(_incoming(spark, people))
    seen = people[:4] + people[6:8]  # a.edu lost two of six; b.edu four of six, more than is believed
    batch = _incoming(spark, seen)
    keyed = batch.select(F.col("school_domain").alias("domain"), s.spec.key.alias("key"))
    log = {r["key"]: r["change"] for r in s.upsert(batch, rosters=keyed, now="2026-01-02").collect()}
    gone = {r["key"]: r["departed_at"] for r in s.read().where("departed").collect()}
    assert set(gone) == {"a.edu|p4", "a.edu|p5"} and set(gone.values()) == {"2026-01-02"} and [log[k] for k in sorted(gone)] == ["departed", "departed"]
    log = {r["key"]: r["change"] for r in s.upsert(_incoming(spark, people[:6])).collect()}
    assert log["a.edu|p4"] == "returned"


def test_stream_upsert_equals_batch(spark, tmp_path):
    people = [{"name": f"P{i % 5}", "school_domain": "a.edu", "emails": [f"{i}@a.edu"], "sport": "Golf" if i % 2 else "Tennis"} for i in range(12)]
    src = _incoming(spark, people).coalesce(1).withColumn("seq", F.monotonically_increasing_id() + 1)
    src.orderBy("seq").repartitionByRange(3, "seq").write.parquet(f"{tmp_path}/in")
    one = Store(spark, f"file://{tmp_path}/stream", schemas.person())
    upsert_stream(event_stream(spark, f"{tmp_path}/in", src.schema), one, f"{tmp_path}/state").awaitTermination()
    two = Store(spark, f"file://{tmp_path}/batch", schemas.person())
    two.upsert(spark.read.parquet(f"{tmp_path}/in"))
    show = lambda s: sorted((r["key"], sorted(r["emails"]), sorted(r["sport"].split("; "))) for r in s.read().collect())
    assert one.version() == 3 and show(one) == show(two)


def test_stream_windows(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(2).write.parquet(f"{tmp_path}/ev")
    for name, build in (("tumbling", tumbling_counts), ("sessions", sessions)):
        q = build(event_stream(spark, f"{tmp_path}/ev", batch.schema, 2)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(str, spark.table(name).drop("total").collect())) == sorted(map(str, build(batch).drop("total").collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_cache(spark, tmp_path):
    rows = [("u", 200, 1.0, "a"), ("u", 200, 5.0, "b"), ("v", 500, 2.0, "c"), (None, 200, 9.0, "d"), ("w", 404, 0.0, "e")]
    df = spark.createDataFrame(rows, "url string, status int, fetched_at double, body string")
    files.cache_write(df.where("url is not null"), f"{tmp_path}/c")
    back = spark.read.parquet(f"{tmp_path}/c")
    assert sorted((r["url"], r["body"]) for r in back.collect()) == [("u", "b"), ("w", "e")]
    assert sorted(r["body"] for r in files.purge(df, 6.0, 4.5).collect()) == ["b", "c"]
    assert tuple(files.purge_counts(df, 6.0, 4.5).first()) == (2, 3)


def test_missing_article_is_skipped(spark, tmp_path):
    (tmp_path / "w.txt").write_text("=== Texas ===\n* [[A College]] Bears in [[Town]]\n")
    got = members.read_wiki(spark, {"NJCAA DI": str(tmp_path / "w.txt"), "NJCAA DII": str(tmp_path / "no.txt")}).collect()
    assert [r["school"] for r in got] == ["A College"]
    with pytest.raises(FileNotFoundError):
        members.read_wiki(spark, {"NJCAA DII": str(tmp_path / "no.txt")})


def _workbook(path, sheets):
    import zipfile

    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared: list[str] = []
    with zipfile.ZipFile(path, "w") as z:
        for n, rows in enumerate(sheets.values(), 1):
            body = ""
            for i, row in enumerate(rows, 1):
                cells = ""
                for k, v in enumerate(row):
                    ref = f"{chr(65 + k)}{i}"
                    if isinstance(v, int):
                        cells += f'<c r="{ref}"><v>{v}</v></c>'
                    elif v is not None and k % 2:
                        cells += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
                    elif v is not None:
                        shared.append(v)
                        cells += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
                body += f'<row r="{i}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        names = "".join(f'<sheet name="{s}" sheetId="{n}" r:id="r{n}"/>' for n, s in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{n}" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><r><t>{v[:2]}</t></r><r><t>{v[2:]}</t></r></si>" for v in shared) + "</sst>")


def test_workbooks(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx", {"Schools": [["School", "State", "Team Page"], ["A College", "TX", None], ["B College", None, "https://b.edu/x"]], "People": [[None, "title"], ["Conference", "x"], ["Big", 7, "--"]]})
    (tmp_path / "b.xlsx").write_bytes(b"not a zip")
    rows = files.read_workbook(spark, str(tmp_path))
    got = sorted(map(tuple, files.workbook_sheet(rows, "Schools").collect()), key=str)
    assert got == [("A College", "TX", None), ("B College", None, "https://b.edu/x")]
    people = files.positional_sheet(rows.where("sheet = 'People'"), {"name": 0, "n": 1, "gap": 2, "none": 9}).collect()
    assert [tuple(r) for r in people] == [("People", 3, "Big", "7", None, None)]


def test_unreadable_store_is_put_aside(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('[{"name": "Ann", "school_domain": "a.edu"}]')
    bad.write_text('{"leads": [{"name": ')
    assert files.quarantine(spark, str(good)) is None and files.quarantine(spark, str(tmp_path / "no.json")) is None
    assert files.quarantine(spark, str(bad)).endswith("bad.corrupt.json") and not bad.exists() and (tmp_path / "bad.corrupt.json").exists()


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "Ünn", "a.edu")], "key string, name string, school_domain string")
    inst = spark.createDataFrame([("i", "A", "DI", "a.edu", None)], "key string, school string, division string, athletics_domain string, website string")
    sinks.export_people(rows, inst, f"{tmp_path}/p.csv", ["name", "nothing"], single=True, bom=True)
    text = next((tmp_path / "p.csv").glob("part*")).read_bytes().decode("utf-8")
    assert text == "\ufeffname,division\nÜnn,DI\n"
    sinks.export_store(rows, f"{tmp_path}/s", "2026-01-01")
    assert json.loads(next((tmp_path / "s" / "about").glob("part*")).read_text()) == {"updated_at": "2026-01-01", "count": 1}


def test_settings():
    from datetime import datetime, timezone

    from rosterlake import settings as C

    s = C.from_environment(environment={"ROSTERLAKE_CACHE_TTL": "5", "ROSTERLAKE_MAX_BACKOFF": "x", "ROSTERLAKE_SAVE_PHOTOS": " Yes ", "ROSTERLAKE_MAX_SPORT_PAGES": "7.9"})
    assert (s.cache_ttl, s.max_backoff, s.save_photos, s.max_sport_pages) == (5.0, 16.0, True, 7) and s.over(cache_ttl=None, data_dir="d").data_dir == "d"
    now = datetime(2026, 1, 2, 3, 4, 5, 6, timezone.utc)
    assert C.run_id(now) == "20260102-030405" and C.stamp(now) == "2026-01-02T03:04:05Z"


def test_store_in_lines(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"name": "Ann", "school_domain": "a.edu", "title": "x"}\n{"name": "Ann", "school_domain": "a.edu", "title": "y", "z": 1}\n{"title": "no name"}\n')
    rows = files.read_store(spark, str(tmp_path / "p.json"), schemas.person(), lines=True).collect()
    assert [(r["name"], r["title"]) for r in rows] == [("Ann", "y")]
