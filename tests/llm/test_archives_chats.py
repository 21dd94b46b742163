"""WARC archives and quotation links."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hexcadence.llm import quotes, warc
from hexcadence.llm.workload import op5_warc, op8_quotation_links

PAGES = "page_id bigint, url string, html string"
BIG = "<p>é漢😀</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40


def pages(spark):
    rows = [
        (1, "http://a.example/1", BIG),
        (5, "http://a.example/5", BIG),
        (3, None, BIG),
        (None, "http://a.example/null", BIG),
        (7, "http://b.example/x\r\nEvil: 1", "small"),
        (8, "http://b.example/8", "small"),
        (9, "", ""),
        (10, "http://c.example/10", None),
        (11, "http://c.example/11", "y" * 1_500_000),
        (12, "http://c.example/12", "z" * 1000),
        (13, "http://c.example/13", "z" * 1000),
        (13, "http://c.example/13", "z" * 1000),
        (14, "http://c.example/14", "z" * 999),
        (15, "http://c.example/15", "z" * 999),
        (-4, "http://d.example/", "\n\n\r\n"),
    ]
    extra = {c: F.lit("mine") for c in ("key", "payload", "digest", "length", "first", "value", "revisits")}
    return spark.createDataFrame(rows, PAGES).withColumns(extra).repartition(3), rows


def expected(rows):
    first = {}
    for k, _, h in rows:
        if h is not None and len(h.encode()) >= 1000:
            first[h] = max(first.get(h, -(10**18)), -(10**18) if k is None else k)
    out = []
    for k, _, h in rows:
        data = (h or "").encode()
        of = first.get(h) if len(data) >= 1000 else None
        revisit = of is not None and k != of
        out.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", of if revisit else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    df, rows = pages(spark)
    path = str(tmp_path_factory.mktemp("warc") / "out")
    warc.write(df, path)
    return path, rows


def test_round_trip(spark, archive):
    path, rows = archive
    records = warc.read(spark, path).collect()
    got = []
    for r in records:
        full = r["record_type"] == "response"
        key = r["record_id"][len("<urn:page:") : -1]
        assert full == (r["payload"] is not None)
        if full:
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_length"]
        refers = None if r["refers_to"] is None else int(r["refers_to"][len("<urn:page:") : -1])
        got.append((None if key == "null" else int(key), r["payload_length"], r["payload_digest"], r["record_type"], refers))
    assert sorted(got, key=str) == expected(rows)
    urls = {r["target_uri"] for r in records}
    assert "http://b.example/x%0D%0AEvil: 1" in urls and None in urls


def test_filters_reach_the_reader(spark, archive):
    path, _ = archive
    df = warc.read(spark, path).where("record_type = 'revisit' AND target_uri LIKE 'http://a%'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and df.count() == 2
    assert warc.read(spark, path).where(F.col("record_id").isin("<urn:page:7>", "<urn:page:8>")).count() == 2
    assert warc.read(spark, path).where("record_type = 'request'").count() == 0
    assert warc.read(spark, path).where("payload_length = 1000").count() == 3


def test_unwanted_payloads_are_not_read(archive, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    path, _ = archive
    taken = []
    take = warc._Bytes.take
    monkeypatch.setattr(warc._Bytes, "take", lambda self, n: taken.append(n) or take(self, n))
    reader = warc.WarcReader({"path": path})
    other = GreaterThan(("payload_length",), 5)
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), other])) == [other]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["record_type"] for r in rows} == {"revisit"} and not taken
    heads = warc.WarcReader({"path": path, "payload": "false", "partitionBytes": "1"})
    assert len(heads.partitions()) > 1
    assert sum(b.num_rows for p in heads.partitions() for b in heads.read(p)) == 15 and not taken


def test_other_records_and_broken_ones(spark, tmp_path):
    text = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\na: b\r\nc:d\r\n\r\n"
    (tmp_path / "one.warc").write_bytes(text * 2)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    rows = warc.read(spark, str(tmp_path)).collect()
    assert [(r["record_type"], bytes(r["payload"]), r["content_length"]) for r in rows] == [("warcinfo", b"a: b\r\nc:d", 9)] * 2
    (tmp_path / "two.warc").write_bytes(b"garbage\r\n")
    with pytest.raises(Exception, match="no WARC record"):
        warc.read(spark, str(tmp_path)).count()
    (tmp_path / "two.warc").write_bytes(text[:-12])
    with pytest.raises(Exception, match="cut short"):
        warc.read(spark, str(tmp_path)).count()


def test_empty_folder_and_table(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert warc.read(spark, str(tmp_path / "a")).count() == 0
    warc.write(pages(spark)[0].limit(0), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b")).count() == 0


def test_query_on_tables_with_copies(spark, tmp_path):
    df, rows = pages(spark)
    df.select("page_id", "url", "html").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(map(tuple, op5_warc(spark, str(tmp_path)).collect()), key=str) == expected(rows)


# --- quotations -------------------------------------------------------------------------------------

CHAT = "conv_id bigint, turn bigint, role string, text string"
A, B, C = "the first question about green tea", "a long answer\nin two lines of text\n\nand a second paragraph here", "something else entirely said now"


def chat(spark):
    rows = [
        (1, 0, "user", A),
        (1, 1, "assistant", B),
        (1, 2, "user", C),
        (1, 3, "assistant", "> The first  QUESTION\n> about green tea\nmy reply"),
        (1, 4, "user", "On Monday, X wrote:\n> in two lines of text\n>> the first question about green tea\nok then"),
        (1, 5, "user", "> a long answer in two lines of text and a second paragraph here\n\n> something else entirely said now\nboth"),
        (1, 6, "user", ">something nobody ever said before"),
        (1, 7, "user", "> ok then"),
        (2, 0, "user", "> " + A),
        (2, 1, "user", A),
        (2, 1, "user", A),
        (None, None, None, None),
        (None, 0, "user", A),
        (None, 2, "user", "> " + A + "\n" + "long " * 20_000),
        (3, None, "user", "> " + A),
        (3, 4, "user", A),
        (3, 5, "user", ""),
    ]
    extra = {c: F.lit("mine") for c in ("uid", "parsed", "body", "position", "reply_to", "anchor", "row", "conv", "units")}
    return spark.createDataFrame(rows, CHAT).withColumns(extra).repartition(3), rows


def brute(rows):
    said = defaultdict(lambda: 10**9)
    parsed = [quotes.parse(r[3]) for r in rows]
    for r, (_, _, units) in zip(rows, parsed, strict=True):
        for level, u in units:
            if level == 0 and r[1] is not None:
                said[r[0], u] = min(said[r[0], u], r[1])
    out = []
    for r, (body, n, units) in zip(rows, parsed, strict=True):
        words = defaultdict(int)
        for level, u in set(units):
            t = said.get((r[0], u))
            if level == 1 and t is not None and t < 10**9 and (r[1] is None or t < r[1]):
                words[t] += len(u.split())
        best = max(words, key=lambda t: (words[t], t), default=None)
        anchor = best if best is not None else None if r[1] is None else r[1] - 1
        out.append([r[0], r[1], body, n, best, anchor])
    result = []
    for conv in {r[0] for r in rows}:
        own = [o for o in out if o[0] == conv]
        own.sort(key=lambda o: (o[5] is None, o[5] or 0, o[1] is None, o[1] or 0))
        result += [(*o[:5], i) for i, o in enumerate(own)]
    return sorted(result, key=str)


def test_parse():
    assert quotes.levels("a\n> b\n>> c\n> > d\n>e\nf > g") == [(0, "a"), (1, "b"), (2, "c\nd"), (1, "e"), (0, "f > g")]
    body, n, units = quotes.parse("hi all there\n\nOn Monday, X wrote:\n> one two three\n\nbye")
    assert body == "hi all there\nbye" and n == 1 and (1, "one two three") in units and (0, "hi all there") in units
    assert quotes.parse(None) == ("", 0, []) and quotes.parse("> only a quote")[0] == ""
    assert quotes.parse("\nkept  as it is\n")[0] == "\nkept  as it is\n"


def test_links_equal_brute_force(spark):
    df, rows = chat(spark)
    out = quotes.linked(df, "conv_id", "turn", "text")
    assert set(df.columns) <= set(out.columns)
    got = out.select("conv_id", "turn", "body", "n_quotes", "reply_to", "position").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    by = {(r["conv_id"], r["turn"]): r["reply_to"] for r in got}
    assert (by[1, 3], by[1, 4], by[1, 5], by[1, 6], by[1, 7], by[2, 0]) == (0, 1, 1, None, 4, None)
    assert by[None, 2] == 0 and by[3, None] == 4


def test_scripts_without_blanks_are_linked(spark):
    said = ["今日はとても良い天気ですね", "我们明天去公园吧", "สวัสดีครับ", "好", "plain words of four", "嗯"]
    rows = [(1, i, "user", t) for i, t in enumerate(said)]
    rows += [(1, 10 + i, "user", f"> {t}\n{i} yes") for i, t in enumerate(said)]
    # Eight letters weigh more than four words.
    rows += [(1, 20, "user", "> 我们明天去公园吧\n\n> plain words of four\nboth")]
    got = quotes.linked(spark.createDataFrame(rows, CHAT), "conv_id", "turn", "text").collect()
    by = {r["turn"]: r["reply_to"] for r in got}
    assert [by[10 + i] for i in range(len(said))] == list(range(len(said))) and by[20] == 1
    assert [quotes.weight(u) for u in ("one two three", "我们", "abc 我们 def", "ok")] == [3, 2, 4, 1]


def test_short_quotes_are_linked(spark):
    said = [(1, "Shall we go?"), (2, "Yes"), (3, "Maybe later"), (4, "> Yes\nGood."), (5, "> Maybe later\n> Yes\nboth"), (6, "Не придём"), (7, "> Не придём\nWhy?"), (8, "> no\nwho?")]
    df = spark.createDataFrame([(1, t, "user", x) for t, x in said], CHAT)
    by = {r["turn"]: r["reply_to"] for r in quotes.linked(df, "conv_id", "turn", "text").collect()}
    assert [by[t] for t, _ in said] == [None, None, None, 2, 3, None, 6, None]


def test_a_reply_follows_what_it_answers(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    said = [" ".join(r.sample(words, 6)) for _ in range(40)]
    rows = [(1, i, "user", (f"> {said[r.randrange(i)]}\n" if i and r.random() < 0.5 else "") + said[i]) for i in range(40)]
    got = quotes.linked(spark.createDataFrame(rows, CHAT), "conv_id", "turn", "text").collect()
    place = {x["turn"]: x["position"] for x in got}
    assert sorted(place.values()) == list(range(40))
    assert all(place[x["reply_to"]] < x["position"] for x in got if x["reply_to"] is not None)
    assert all(">" not in x["body"] for x in got)


def test_query_without_quotes_keeps_turns(spark):
    sf = "/root/testdata/sf0.001"
    rows = op8_quotation_links(spark, sf).collect()
    chats = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    want = brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in chats])
    assert sorted(((r["conv_id"], r["turn"], r["body"], r["n_quotes"], r["reply_to"], r["position"]) for r in rows), key=str) == want


def test_empty_chats(spark):
    assert quotes.linked(spark.createDataFrame([], CHAT), "conv_id", "turn", "text").count() == 0
