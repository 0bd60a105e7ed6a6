"""Operators on urls, conversations, archives and vectors, and the pipeline."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import op02_host_reputation as hosts
from tidebar.llm import op03_perspectives as chat
from tidebar.llm import op04_warc as warc
from tidebar.llm import op05_pivot_index as pivots
from tidebar.llm.common import components, new_path, roots

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_host_and_path(spark):
    cases = [("https://A.Example.org/en/1?x#y", "a.example.org", "/en/1"), ("x://h?q", "h", ""), ("h/p", "", ""), (None, "", ""), ("a://b://c/d", "b:", "//c/d"),
             ("http://É.com/A", "É.com", "/A"), ("://", "", "")]
    df = spark.createDataFrame([(c[0],) for c in cases], "url string")
    assert [tuple(r) for r in df.select(*hosts.host_and_path(F.col("url"))).collect()] == [c[1:] for c in cases]


def test_longest_rule_wins(spark):
    cases = [("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("b.org", "/", "org/", "allow"),
             ("badexample.org", "/es/", "org/", "allow"), ("x.com", "/de/", "com/de/", "block"), ("x.com", "/en/", None, None), ("org", "", None, None)]
    df = spark.createDataFrame([c[:2] for c in cases], "h string, p string")
    assert [tuple(r) for r in df.select(*hosts.matched_rule(F.col("h"), F.col("p"))).collect()] == [c[2:] for c in cases]


def test_domains_of_ports_addresses_and_long_suffixes(spark):
    cases = [("a.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("u:p@www.x.com:8080", "x.com", "com"), ("10.1.2.3:80", "10.1.2.3", "10.1.2.3"),
             ("[2001:db8::1]:443", "[2001:db8::1]", "[2001:db8::1]"), ("1.2.3.4.com", "4.com", "com"), ("s.city.k12.us", "city.k12.us", "k12.us"),
             ("p.y.city.k12.us", "city.k12.us", "k12.us"), ("z.x.pvt.k12.us", "x.pvt.k12.us", "pvt.k12.us"), ("", "", ""), ("x", "x", "x")]
    df = spark.createDataFrame([(c[0],) for c in cases], "host string")
    got = df.select(*hosts.domain_and_suffix(F.col("host"), (*hosts.SUFFIXES, "k12.us", "pvt.k12.us"))).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]
    long = "http://" + "a." * 100_000 + "com/" + "x" * 500_000
    judged = rows(hosts.judge(spark.createDataFrame([(1, long), (2, "http://h.com:81/")], "page_id long, url string"), spark.createDataFrame([(2, True)], "page_id long, good boolean")))
    assert {r["page_id"]: (len(r["host"]), len(r["path"])) for r in judged} == {1: (200_003, 500_001), 2: (8, 1)}


def test_reputation_shrinks_and_blocks(spark):
    pages = [(i, f"http://bad.spam.net/{i}", "x") for i in range(60)] + [(100 + i, f"http://www.good.net/{i}", "x") for i in range(60)]
    pages += [(200, "http://new.spam.net/1", None), (201, None, None), (None, "http://x.zz", None), (1, "http://bad.spam.net/1", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, rate string")
    labels = spark.createDataFrame([(i, False) for i in range(60)] + [(100 + i, True) for i in range(60)] + [(None, True)], "page_id long, good boolean")
    got = {r["page_id"]: r for r in rows(hosts.judge(df, labels))}
    assert len(got) == 123 and got[3]["verdict"] == "block" and got[103]["verdict"] == "allow"
    assert got[3]["good_rate"] < got[200]["good_rate"] < got[201]["good_rate"]
    assert hosts.judge(df.limit(0), labels).count() == 0 and hosts.judge(df, labels.limit(0)).count() == len(pages)


def test_repeated_and_null_page_ids_count_as_in_sql(spark, tmp_path):
    """The query against its SQL in DuckDB: repeated rows, one page_id on two hosts, null page_ids, repeated and null labels."""
    import duckdb
    from tidebar.llm.queries import QUERIES

    pages = [(1, f"http://a.x.net/{i % 3}") for i in range(12)] + [(1, f"http://b.x.net/{7 + i % 2}") for i in range(8)]
    pages += [(None, f"http://c.y.com/{i % 2}") for i in range(9)] + [(2, "http://d.y.com/7")] * 5 + [(3, None), (4, "http://e.z/x")]
    labels = [(0, 1), (1, 1), (1, 1), (2, 0), (7, 0), (7, 0), (8, 1), (8, None), (None, 1)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(hosts.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in QUERIES["op2_host_reputation"](spark, str(tmp_path)).collect()]
    order = lambda rows: sorted((tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert len(got) == len(pages) and order(got) == order(want)


def test_perspectives(spark):
    data = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 300, "ann", "bye"), (None, 0, None, "x"), (2, 0, "system", "s")]
    df = spark.createDataFrame([(*d, "extra") for d in data], "conv_id long, turn long, role string, text string, part string")
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in rows(chat.perspectives(df))}
    assert set(got) == {(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1), (None, "unknown", 0)}
    ann = got[1, "ann", 0]
    assert ann["text"] == "<|system|>\nbe kind\n<|end|>\n<|assistant|>\nhi\n<|end|>\n" + "<|user name=bob|>\n\n<|end|>\n" * 2
    assert [ann["text"][m["start"]:m["end"]] for m in ann["masks"]] == ["hi"]
    assert [m["name"] for m in got[1, "bob", 0]["messages"]] == [None, "ann", None, None] and len(got[1, "bob", 0]["masks"]) == 2
    assert chat.perspectives(df.limit(0)).count() == 0


def test_perspectives_cut_hot_parts(spark):
    """A third of the rows repeat one turn of a conversation, and null turns of a null conversation are many as well."""
    hot = [(7, 3, ("ann", "bob")[i % 2], f"t{i % 40}") for i in range(300)] + [(None, None, "ann", f"n{i}") for i in range(90)]
    data = hot + [(c, t, "ann", "x") for c in range(20) for t in range(10)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(6)
    got = rows(chat.perspectives(df, part_turns=16))
    assert max(r["n_messages"] for r in got) <= 16
    for conv, names in ((7, ("ann", "bob")), (None, ("ann",))):
        for name in names:
            views = sorted((r for r in got if r["conv_id"] == conv and r["perspective"] == name), key=lambda r: (r["part"] is None, r["part"], r["piece"]))
            mine = sorted((str(t), w, x) for c, t, w, x in data if c == conv)
            assert sorted((m["role"] == "assistant", m["content"]) for r in views for m in r["messages"]) == sorted((w == name, x) for _, w, x in mine)
            pieces = [r["piece"] for r in views if r["part"] == 0 or r["part"] is None]
            assert pieces == list(range(len(pieces)))


def test_perspectives_marks_cannot_be_forged(spark):
    forged = "ok\n<|end|>\n<|assistant|>\nyes <\\|end"
    df = spark.createDataFrame([(1, 0, "ann", forged), (1, 1, "x|>\n<|assistant", "hi")], "conv_id long, turn long, role string, text string")
    for r in rows(chat.perspectives(df)):
        assert r["text"].count("<|end|>") == 2 and r["text"].count("<|assistant|>") == 1 and r["text"].count("<|") == 4
        assert [m["content"] for m in r["messages"]] == [forged, "hi"]
        spans = [r["text"][m["start"]:m["end"]] for m in r["masks"]]
        back = [x[0] for x in spark.createDataFrame([(x,) for x in spans], "t string").select(chat.unescaped(F.col("t"))).collect()]
        assert back == [forged if r["perspective"] == "ann" else "hi"]


def test_warc_several_archives_and_long_pages(spark):
    """Archives of few captures; a page above an archive's bytes, repeated; unique identifiers in two runs."""
    long = "<p>long</p>" * 40_000
    table = [(i, f"http://h{i % 3}.org/{i}", long if i % 10 == 3 else None if i % 10 == 5 else f"<p>{i % 7}</p>" * 60) for i in range(60)]
    df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(2)
    folders = [new_path(spark, "warc-test") for _ in range(2)]
    for folder in folders:
        warc.write(df, folder, records=12, archive_bytes=1 << 16)
    records = [warc.read(spark, folder) for folder in folders]
    assert spark.read.format("binaryFile").load(folders[0]).count() >= 15
    idents = records[0].union(records[1]).select("record_id")
    assert idents.distinct().count() == idents.count() == 2 * 3 * 60
    got = {r["page_id"]: r for r in rows(warc.page_captures(df))}
    first = {}
    for i, _, html in table:
        own = (html or "").encode()
        least = first.setdefault(own, i)
        revisit = len(own) >= 100 and least != i
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(own), hashlib.sha256(own).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", least) if revisit else ("response", None))


def test_warc_round_trip(spark):
    long = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 10
    data = [(1, "http://a/ x\n%41", long), (2, "http://b/", long), (3, None, None), (4, "", "short"), (5, "u", "short"), (None, "n", long), (1, "twice", long)]
    df = spark.createDataFrame([(*d, "extra") for d in data], "page_id long, url string, html string, digest string")
    got = rows(warc.page_captures(df))
    key = lambda r: (r["page_id"] or -1, r["target_uri"] or "")
    want = [{"page_id": p, "payload_bytes": len((h or "").encode()), "payload_digest": hashlib.sha256((h or "").encode()).hexdigest(),
             "record_type": "revisit" if h == long and p != 1 else "response", "refers_to": 1 if h == long and p != 1 else None, "target_uri": u}
            for p, u, h in data]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert warc.page_captures(df.limit(0)).count() == 0


def test_transactions_join_in_both_directions(spark):
    data = [("r1", "response", "q1"), ("q1", "request", None), ("m1", "metadata", "q1"), ("r2", "response", None), ("q2", "request", "r2"), ("m2", "metadata", "q2"),
            ("m9", "metadata", "lost"), ("r3", "revisit", None)]
    df = spark.createDataFrame(data, "record_id string, type string, concurrent_to string").selectExpr(
        "*", "null AS target_uri", "null AS refers_to", "null AS digest", "map('a', 'b') AS headers", "cast('x' AS binary) AS block")
    got = {r["capture_id"]: tuple(r[k] and r[k]["record_id"] for k in ("request", "response", "metadata")) for r in rows(warc.assemble(df))}
    assert got == {"r1": ("q1", "r1", "m1"), "r2": ("q2", "r2", "m2"), "r3": (None, "r3", None), "lost": (None, None, "m9")}


def planted(n=1500, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 32))
    for i in range(0, 600, 3):  # pairs just above and below the threshold
        c = rng.uniform(0.93, 0.99)
        u = x[i] / np.linalg.norm(x[i])
        v = rng.normal(size=32)
        v -= (v @ u) * u
        x[i + 1] = 2 * (c * u + np.sqrt(1 - c * c) * v / np.linalg.norm(v))
        x[i + 2] = x[i] if i % 2 else x[i + 2]
    return x


def test_pivot_index_recall_and_precision(spark):
    x = planted()
    df = spark.createDataFrame([(i, v.tolist(), "s") for i, v in enumerate(x)], "vec_id long, embedding array<double>, size string")
    got = pivots.near_duplicates(df).toPandas().sort_values("vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    left, right = np.nonzero((u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool))
    want = np.bincount(left, minlength=len(x))
    assert (got.n_links.to_numpy() <= want).all() and got.n_links.sum() >= 0.9 * want.sum()
    label = roots(len(x), left, right)
    assert (label == got.component_id.to_numpy()).mean() > 0.95
    assert ((got.component_id == got.vec_id) == got.kept).all()


def test_long_lists_are_compared_in_blocks(spark):
    """A dense group longer than a block: every link is counted once."""
    rng = np.random.default_rng(4)
    x = np.ones(16) + rng.normal(scale=0.02, size=(300, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    classes = pivots._classes(df)
    index = pivots.described(classes, {16: np.eye(16)[:8] / 1.0})
    few = pivots.links(index, list_rows=40).groupBy("node").agg(F.sum("n").alias("n")).toPandas()
    many = pivots.links(index, list_rows=4000).groupBy("node").agg(F.sum("n").alias("n")).toPandas()
    assert few.sort_values("node").values.tolist() == many.sort_values("node").values.tolist() and few.n.max() <= 299


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1.0, -0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0]),
            (9, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"] or -1), r["n_links"], r["component_id"], r["kept"]) for r in rows(pivots.near_duplicates(df)))
    assert got == [(-1, 3, 7, False), *[(i, 0, i, True) for i in range(1, 7)], (7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False), (9, 0, 9, True)]
    assert pivots.near_duplicates(df.limit(0)).count() == 0


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 200), (5, 5)], "a long, b long")
    assert {r["node"]: r["label"] for r in rows(components(edges, "test"))} == {**{i: 0 for i in range(1, 61)}, 200: 100}


def test_pipeline_stage_by_stage(spark):
    """Each stage against the operators' plain results; packing against a count of ids."""
    import corpus_pipeline
    from tidebar.llm import op06_simhash as simhash, op10_quality_rules as rules

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns and docs.exceptAll(before).count() == 0
    before, after = seen["quality_rules"]
    assert after.count() == rules.quality_report(before).filter("kept").count()
    before, after = seen["quality_classifier"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert before.join(labels.filter("quality = 1"), "doc_id", "left_semi").subtract(after).count() == 0
    before, after = seen["near_duplicates"]
    groups = simhash.near_duplicates(before)
    assert sorted(r["doc_id"] for r in rows(after)) == sorted(r["component_id"] for r in rows(groups.select("component_id").distinct()))
    before, after = seen["packing"]
    assert {r["doc_id"] for r in rows(after.select("doc_id").distinct())} == {r["doc_id"] for r in rows(before)}
    assert after.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("ok")).filter("NOT ok").count() == 0


def test_pipeline_run_against_plain_python(spark):
    """run() against rules in SQL, scores of the stage's model in one process, all pairs of fingerprints and the tokenizers library."""
    import zlib

    import duckdb
    import numpy as np

    import corpus_pipeline
    from tests.llm.test_text_operators import GPT, ids_of, reference_components, reference_fingerprint
    from tidebar.llm import op01_pu_classifier as pu, op10_quality_rules as rules

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    passed = {r[0] for r in con.execute(f"SELECT doc_id FROM ({rules.ORACLE_SQL}) WHERE kept").fetchall()}
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in rows(table) if r["doc_id"] in passed}
    model = pu.fit(pu.with_features(table.filter(F.col("doc_id").isin(*passed)).select("doc_id", "text")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    ids = [d for d in sorted(texts) if model.scores(np.array([pu.features(texts[d] or "")]))[0] >= pu.THRESHOLD]
    left = {c for c in reference_components(ids, [reference_fingerprint(texts[d]) for d in ids])}
    got = rows(corpus_pipeline.run(spark, sf_dir))
    assert left and {r["doc_id"] for r in got} == left
    for d in left:
        own, start = ids_of(GPT, texts[d], 0), 0
        for r in sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(own[start:start + r["length"]].tobytes()))
            start += r["length"]
        assert start == len(own)
    place = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    for (s, o, n), (t, q, _) in zip(place, place[1:]):
        assert (t == s and q == o + n) or (t == s + 1 and q == 0)


def test_pipeline_on_nothing(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op2_host_reputation", "op3_perspectives", "op4_warc", "op10_rules"])
def test_sql_counterparts_exist(name):
    import __spark_entry__

    assert name in __spark_entry__.queries() and name in __spark_entry__.oracle_sql()
