"""The retrieval engine against DuckDB and small hand-made cases."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textloom import cli
from textloom.functions import stem
from textloom.functions import text as tx
from textloom.functions.embed import HashingEmbedder, ModelEmbedder, fill
from textloom.functions.stem import porter
from textloom.operators import chunk, evaluate, index, rank
from textloom.operators import rows as in_rows
from textloom.operators import store
from textloom.operators.store import Index
from textloom.plans import search as plan
from textloom.sources import datasets, extract, files
from textloom.streaming import changes

TABLES = "events documents embeddings pages benchmark labels conversations orders".split()
SAMPLED = "tokenize detect_phrases extract_keywords snippet ext_filter src_walk_filter sync_ignore extract_html_text span_chunk markdown_chunk term_frequency search_bm25 boosted_fusion jaccard_dedup search_hybrid ndcg_at_k discover_new_files embedding_upsert remove_files debounce_sessions change_coalesce pred_is_text normalize_text extract_json_values extract_csv cosine_topk_exact phrase_match compare_runs eval_report index_build index_refresh index_vocabulary index_compact search_chunks vector_fetch".split()


def rows(frame, names):
    fix = lambda v: tuple(v.tolist() if hasattr(v, "tolist") else v) if hasattr(v, "__len__") and not isinstance(v, str) else round(v, 5) if isinstance(v, float) else v
    return sorted(map(repr, (tuple(fix(v) for v in r) for r in frame[names].itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", SAMPLED)
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = entry.queries()[name](spark, sf).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert rows(got, names) == rows(want, names)


def test_search_gives_each_query_ordered_hits(spark, sf):
    hits = entry.queries()["search"](spark, sf).toPandas()
    assert len(hits) and set(hits["rank_stage"]) <= {"S1", "S1_embed_fail", "S3_RRF", "S3_MMR"}
    for _, h in hits.groupby("query_id"):
        assert sorted(h["rank"]) == list(range(len(h))) and len(h) <= 20


def test_dedup_keeps_the_best_of_alike_texts(spark):
    d = spark.createDataFrame([(1, 0, 10, "a b c"), (1, 1, 11, "c b a"), (1, 2, 12, "x y")], "query_id long, rank int, doc_id long, text string")
    assert [(r.doc_id, r.new_rank) for r in rank.dedup(d).orderBy("new_rank").collect()] == [(10, 0), (12, 1)]


def test_minmax_of_equal_scores_is_a_half(spark):
    d = spark.createDataFrame([(1, 2.0), (1, 2.0)], "query_id long, score double")
    assert {r.n for r in d.select(rank.minmax(F.col("score")).alias("n")).collect()} == {0.5}


def test_mmr_starts_with_the_best_and_skips_rows_without_vectors(spark):
    d = spark.createDataFrame([(1, 1, 0.9, 0.9, [1.0, 0.0]), (1, 2, 0.8, 0.8, [1.0, 0.0]), (1, 3, 0.7, 0.7, [0.0, 1.0]), (1, 4, 0.6, 0.0, None)], "query_id long, doc_id long, score double, sim double, v array<double>")
    assert [r.doc_id for r in rank.mmr(d).orderBy("mmr_rank").collect()] == [1, 3, 2]


def test_measures_of_a_known_run(spark):
    run = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (1, 7, 2)], "query_id long, doc_id long, rank int")
    rel = spark.createDataFrame([(1, 6, 1), (2, 9, 1)], "query_id long, doc_id long, rel int")
    r = {x.query_id: x for x in evaluate.measures(run, rel).collect()}
    assert (r[1].mrr, r[1].recall, r[1].map, r[2].mrr) == (0.5, 1.0, 0.5, 0.0)


def test_chunks_by_kind(spark):
    d = spark.createDataFrame([("# A\nx\n\nTitle\n=====\ny", ".md"), ("import a\ndef f():\n  pass\nclass B:\n  pass", ".py"), (" ", ".txt")], "t string, e string")
    assert [[x.chunk for x in r.c] for r in d.select(chunk.chunks(F.col("t"), F.col("e")).alias("c")).collect()] == [["# A\nx", "Title\n=====\ny"], ["import a", "def f():\n  pass", "class B:\n  pass"], []]


def test_json_and_csv_and_mail():
    assert extract.mail_text(b"Subject: Hi\nContent-Type: text/plain\n\nBody\n") == "Subject: Hi\nBody"
    assert extract.strict_html("<p>a</p><script>b</script><p>c</p>") == "a\nc"


def test_formats(spark):
    d = spark.createDataFrame([('{"a": "x", "b": 2, "c": [1], "d": null}', 'a,b\n1,"2,3"', '{"text": "t1"}\nbad\n{"k": 5}')], "j string, c string, l string")
    r = d.select(extract.json_values(F.col("j")), extract.csv_text(F.col("c")), extract.jsonl_text(F.col("l"))).first()
    assert tuple(r) == ("x 2", "a b 1 2,3", "t1\n5")
    d = spark.createDataFrame([('{"a":"[draft] keep me","b":true,"c":"x"}',), ("bad",), ("[1,\"y\",{}]",), ("\"s\"",)], "j string")
    assert [x[0] for x in d.select(extract.json_values(F.col("j"))).collect()] == ["[draft] keep me True x", None, "1 y", "s"]
    d = spark.createDataFrame([("<p>caf&eacute; &mdash; &#8364;5</p>",), (None,)], "h string")
    assert [x[0] for x in d.select(extract.html_text(F.col("h"))).collect()] == ["café — €5", None]


def test_listing_of_a_folder(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("*.skip.md\nfar/\n# c\n!a.txt\n")
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / ".gitignore").write_text("only_here.txt\n")
    more = (("x.skip.md", b"x"), ("far/k.txt", b"x"), ("n/only_here.txt", b"x"), ("only_here.txt", b"x"), ("Notes", "é".encode()), ("blob", b"a\0b"), ("latin", b"\xff\xfe"), ("Makefile", b"x"))
    for name, text in (*more, ("a.txt", b"x"), ("b.png", b"x"), ("n/c.py", b"x = 1"), ("node_modules/d.js", b"x"), (".h/e.txt", b"x"), ("go.sum", b"x"), ("empty.md", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    got = {r.path.removeprefix(f"{tmp_path}/") for r in files.list_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt", "n/c.py", "only_here.txt", "Notes", "Makefile"}
    every = {r.path.removeprefix(f"{tmp_path}/") for r in files.list_files(spark, str(tmp_path), gitignore=False, exclude=["n", "Make*"]).collect()}
    assert every == {"a.txt", "x.skip.md", "far/k.txt", "only_here.txt", "Notes"}
    read = {r.path.removeprefix(f"{tmp_path}/"): r.text for r in extract.extract_text(files.read_files(spark, str(tmp_path))).collect()}
    assert read == {"a.txt": "x", "n/c.py": "x = 1", "only_here.txt": "x", "Notes": "é", "Makefile": "x"}


def test_shared_vectors_outlive_one_of_their_files(spark):
    cat = spark.createDataFrame([("f1", "/a"), ("f2", "/b")], "file_uid string, path string")
    ch = spark.createDataFrame([("f1", "h1"), ("f1", "h2"), ("f2", "h2")], "file_uid string, text_hash string")
    v = spark.createDataFrame([("h1",), ("h2",)], "text_hash string")
    c, k, w = index.remove_files(cat, ch, v, spark.createDataFrame([("/a",)], "path string"))
    assert ([r.path for r in c.collect()], k.count(), [r.text_hash for r in w.collect()]) == (["/b"], 1, ["h2"])


def test_streaming_changes_equal_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("op"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {}
    q = changes.watch(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), lambda dirty, gone: got.update(dirty=dirty.count() + gone.count()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert got["dirty"] == changes.last_changes(e).count()


def test_keywords_put_numbers_first(spark):
    r = spark.sql("SELECT 'set 42 alpha be gamma alpha' AS q").select(tx.keywords(F.col("q"))).first()
    assert r[0] == ["42", "alpha", "gamma", "set"]


STEMS = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit radically radic vietnamization vietnam predication predic feudalism feudal decisiveness decis hopefulness hope formaliti formal sensibiliti sensibl triplicate triplic electriciti electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust irritant irrit replacement replac adjustment adjust adoption adopt communism commun activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll running run runs run".split()


def test_stems_of_known_words():
    assert [porter(w) for w in STEMS[::2]] == STEMS[1::2]
    assert [porter(w) for w in ("a", "is", "é", "x1s", "")] == ["a", "is", "é", "x1s", ""]


def test_stems_and_folding_match_other_forms(spark):
    d = spark.createDataFrame([(1, "He runs daily"), (2, "a running café"), (3, "run"), (4, "rune")], "doc_id long, text string")
    posted = index.postings(d, "doc_id").withColumn("stem", stem.stem(F.col("term")))
    q = spark.createDataFrame([(1, "Running CAFÉS")], "query_id long, text string")
    assert {r.doc_id for r in rank.stem_match(q, posted, "doc_id").collect()} == {1, 2, 3}
    r = d.select(stem.folded_tokens(F.lit("Ünïcode ŁÓDŹ naïve 北京 x_1"))).first()[0]
    assert r[0] == "unicode" and r[2:] == ["naive", "北京", "x", "1"]


def test_phrases_stand_together_and_in_order(spark):
    d = spark.createDataFrame([(1, "a b c a b"), (2, "b a"), (3, "a, B!"), (4, "a x b"), (5, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "A b"), (2, ""), (3, "b b")], "query_id long, text string")
    assert {(r.query_id, r.doc_id, r.times) for r in rank.phrase_match(q, d).collect()} == {(1, 1, 2), (1, 3, 1)}


def test_a_query_can_ask_for_more_than_twenty(spark):
    d = spark.createDataFrame([(i, f"/f{i}.txt", f"token word{i} shared{i % 7}") for i in range(60)], "doc_id long, path string, text string")
    q = spark.createDataFrame([(1, "token")], "query_id long, text string")
    e = plan.Engine(d)
    assert [e.rank(q, "bm25", k).count() for k in (5, 50)] == [5, 50]
    assert [e.search(q, k=k).count() for k in (5, 40)] == [5, 40]


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    for name in ("search_bm25", "topk_per_query", "cosine_topk_exact"):
        p = entry.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "WindowGroupLimit" in p and (name != "cosine_topk_exact" or "NestedLoopJoin" not in p)
    p = entry.queries()["term_frequency"](spark, sf)._jdf.queryExecution().toString()
    assert "Exchange" not in p.split("== Physical Plan ==")[1]


def test_debounced_sessions_over_the_ends_of_spans(spark):
    d = spark.sql("SELECT id AS event_id, timestamp_seconds(t) AS ts FROM (SELECT posexplode(array(0, 1, 86399, 86400, 86401, 172799, 172801, 172803, 259300, 259300)) AS (id, t))")
    got = sorted((r.first_ts.timestamp(), r.last_ts.timestamp(), r.n_events) for r in changes.debounced(d, 2).collect())
    assert got == [(0, 1, 2), (86399, 86401, 3), (172799, 172803, 3), (259300, 259300, 2)]
    want = sorted((r.first_ts.timestamp(), r.last_ts.timestamp(), r.n_events) for r in changes.debounced(d, 2, "1000 days").collect())
    assert got == want


def test_index_life(spark, tmp_path):
    f = lambda *rows: spark.createDataFrame([(p, len(t), m, t) for p, m, t in rows], "path string, size long, mtime double, text string")
    ix = Index(spark, f"file://{tmp_path}/ix").build(f(("/a.txt", 1.0, "red fish"), ("/b.txt", 1.0, "blue fish"), ("/d/c.txt", 1.0, "one fish")))
    words = lambda: {r.term: (r.df, r.cnt) for r in ix.vocabulary().collect()}
    assert words()["fish"] == (3, 3) and ix.under("/d").count() == 1
    before = ix._state()[0]
    ix.refresh(f(("/a.txt", 2.0, "red fish"), ("/b.txt", 2.0, "blue cat cat"), ("/d/c.txt", 1.0, "one fish")))
    assert words() == {"red": (1, 1), "fish": (2, 2), "blue": (1, 1), "cat": (1, 2), "one": (1, 1)} and ix._state()[0] == before + 2
    assert {(r.path, r.mtime) for r in ix.files().collect()} == {("/a.txt", 2.0), ("/b.txt", 2.0), ("/d/c.txt", 1.0)}
    ix.sweep(f(("/a.txt", 2.0, ""), ("/b.txt", 2.0, "")))
    assert {(r.path, r.status) for r in ix.files().collect()} == {("/a.txt", "active"), ("/b.txt", "active"), ("/d/c.txt", "missing")} and ix.chunks().count() == 2
    ix.refresh(f(("/d/c.txt", 1.0, "one fish")))  # it is back, unchanged
    assert words()["fish"] == (2, 2) and ix.totals().first().n == 3
    ix.remove(spark.createDataFrame([("/a.txt",), ("/no",)], "path string"))
    ix.compact()
    assert words() == {"blue": (1, 1), "cat": (1, 2), "one": (1, 1), "fish": (1, 1)} and ix.totals().first().n == 2
    fill(ix, HashingEmbedder(16), 5.0)
    assert ix.vectors("hashing", 16, "1").count() == 2 and ix.vectors("hashing", 16, "2").count() == 0
    ix.remove(spark.createDataFrame([("/b.txt",)], "path string")).drop_vectors(6.0)
    assert ix.vectors("hashing", 16, "1").count() == 1 and ix.status().first().files == 1
    hits = plan.Engine.of(ix, ("hashing", 16, "1")).search(spark.createDataFrame([(1, "fish")], "query_id long, text string")).collect()
    assert [(r.path, r.rank_stage) for r in hits] == [("/d/c.txt", "S1_embed_fail")]
    ix._write("chunks", spark.createDataFrame([("x", "f", "/p", 0, "simple", "t", b"0")], store.TABLES["chunks"]), ix._state()[0] + 1)  # a change that died before its commit
    assert ix.chunks().count() == 1
    assert ix.clear().files().count() == 0 and words() == {}


def test_embedders(spark):
    d = spark.createDataFrame([(1, "a b b"), (2, "b a b"), (3, "")], "id long, text string")
    v = {r.id: r.v for r in HashingEmbedder(8).embed(d).collect()}
    assert v[1] == v[2] and v[3] is None and abs(sum(x * x for x in v[1]) - 1) < 1e-6

    def load():
        def model(texts):
            if "" in texts:
                raise OSError
            return [[len(t), 0.0] for t in texts]

        return model

    v = {r.id: r.v for r in ModelEmbedder(load, 2, "m", batch=1).embed(d.coalesce(1)).collect()}
    assert abs(v[1][0] - 1) < 1e-6 and v[3] is None


def test_p_values_of_students_t(spark):
    # fixed values: two-sided tail areas from published tables
    rows = [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.776, 4, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05), (2.845, 20, 0.01), (1.699, 29, 0.1), (0.0, 7, 1.0)]
    d = spark.createDataFrame(rows, "t double, df long, p double")
    assert all(abs(r[0] - r[1]) < 2e-4 for r in d.select(evaluate.two_sided_p(F.col("t"), F.col("df")), "p").collect())


def test_collections_and_query_files(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id":"d1","title":"T","text":"alpha beta"}\n{"_id":"d2","title":"","text":"gamma"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id":"q1","text":"alpha"}\n{"_id":"q2","text":"no judgment"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0\n")
    docs, queries, rel = datasets.collection(spark, str(tmp_path))
    assert {(r.doc_id, r.text) for r in docs.collect()} == {("d1", "T\n\nalpha beta"), ("d2", "gamma")}
    assert [r.query_id for r in queries.collect()] == ["q1"] and [(r.doc_id, r.rel) for r in rel.collect()] == [("d1", 1)]
    assert evaluate.report({"bm25": plan.Engine(docs).rank(queries, "bm25")}, rel).first().ndcg == 1.0
    (tmp_path / "q.txt").write_text("# c\none\n\n two \none\n")
    assert [(r.query_id, r.text) for r in datasets.query_file(spark, str(tmp_path / "q.txt")).orderBy("query_id").collect()] == [(1, "one"), (3, "two")]
    assert datasets.made_corpus(spark, 5).count() == 5 and datasets.made_corpus(spark, 5).collect() == datasets.made_corpus(spark, 5).collect()


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("TEXTLOOM_CONFIG", str(tmp_path / "c.json"))
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("the quick red fox")
    (docs / "b.md").write_text("a slow green turtle")
    assert cli.main(["config", "index", f"file://{tmp_path}/ix"]) == 0 and cli.main(["db-path"]) == 0
    assert capsys.readouterr().out.strip() == f"file://{tmp_path}/ix"
    assert cli.main(["turtle", "fox", str(docs), "--json"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert [(o["query"], [h["path"] for h in o["hits"]]) for o in out] == [("turtle", [str(docs / "b.md")]), ("fox", [str(docs / "a.txt")])]
    (docs / "c.txt").write_text("another fox")
    (docs / "b.md").unlink()
    assert cli.main(["watch", str(docs), "--passes", "1", "--debounce", "0", "--no-initial-index"]) == 0
    capsys.readouterr()
    assert cli.main(["ls", str(docs)]) == 0
    assert [x.split()[-1].rpartition("/")[2] for x in capsys.readouterr().out.splitlines()] == ["a.txt", "c.txt"]
    assert cli.main(["search", "fox", "-p", str(docs), "--mode", "bm25", "--no-index"]) == 0 and capsys.readouterr().out.count("fox") >= 3
    assert cli.main(["exclude", "add", "*.tmp"]) == 0 and cli.main(["exclude", "remove", "no"]) == 1 and cli.main(["exclude", "list"]) == 0
    assert capsys.readouterr().out.strip() == "*.tmp"
    assert cli.main(["status"]) == 0 and cli.main(["sweep", str(docs)]) == 0 and cli.main(["clear"]) == 0 and cli.main(["version"]) == 0
    assert [cli.main(a) for a in (["search"], ["config", "nothing"], ["ls", "--wrong"], ["eval", str(docs)])] == [2, 1, 2, 1]
    assert (cli.human_size(1536), cli.ago(None, 5), cli.ago(1, 7300), cli.shown_path("/a/b", "/a")) == ("1.5 KB", "never", "2h ago", "b")


def sql_rows(q, **views):
    con = duckdb.connect()
    for name, made in views.items():
        con.sql(f"CREATE VIEW {name} AS {made}")
    return con.sql(q).df()


def test_references_without_a_semicolon_match_sql(spark, tmp_path):
    pages = "SELECT * FROM (VALUES (1, '<title>a&amp;&amp</title><p>b &lt c &amp;gt &#39;</p>'), (2, '')) t(page_id, html)"
    duckdb.connect().sql(f"COPY ({pages}) TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    got = entry.queries()["extract_html_text"](spark, str(tmp_path)).toPandas()
    assert rows(got, ["page_id", "text"]) == rows(sql_rows(entry.oracle_sql()["extract_html_text"], pages=pages), ["page_id", "text"])
    assert spark.range(1).select(extract.html_text(F.lit("<p>a &amp b</p>"))).first()[0] == "a & b"


def test_values_that_round_to_zero_keep_their_sign(spark, tmp_path):
    spark.sql("SELECT 1 AS vec_id, array(3.0F, -0.000001F, 0.0F, 4.0F) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["l2_normalize"](spark, str(tmp_path)).first().unit
    want = sql_rows(entry.oracle_sql()["l2_normalize"], embeddings=f"SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")["unit"][0]
    assert list(map(repr, got)) == [repr(float(x)) for x in want] == ["0.6", "-0.0", "0.0", "0.8"]


def test_blank_texts_are_normalized_as_in_sql(spark, tmp_path):
    docs = "SELECT * FROM (VALUES (1, ''), (2, '  ' || chr(10)), (3, ' a  b '), (4, NULL)) t(doc_id, text)"
    duckdb.connect().sql(f"COPY ({docs}) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    got = entry.queries()["normalize_text"](spark, str(tmp_path)).toPandas()
    assert rows(got, ["doc_id", "text"]) == rows(sql_rows(entry.oracle_sql()["normalize_text"], documents=docs), ["doc_id", "text"])


def test_a_phrase_at_once_after_itself_counts_as_in_sql(spark, tmp_path):
    docs = "SELECT * FROM (VALUES (1, 'x y z x y z'), (2, 'x y z, w x y z x y z'), (3, 'a a a a'), (4, 'x y')) t(doc_id, text)"
    asked = "SELECT * FROM (VALUES (1, 'p q x Y z'), (2, 'p q a a')) t(item_id, text)"
    for name, made in (("documents", f"SELECT *, '' AS lang, '' AS source FROM ({docs})"), ("benchmark", asked)):
        duckdb.connect().sql(f"COPY ({made}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got = entry.queries()["phrase_match"](spark, str(tmp_path)).toPandas()
    names = ["query_id", "doc_id", "times"]
    assert rows(got, names) == rows(sql_rows(entry.oracle_sql()["phrase_match"], documents=docs, benchmark=asked), names)


def test_a_character_split_by_the_cut_at_8_kb_is_text(spark):
    d = spark.createDataFrame([(b"x" * 8191 + "é".encode() + b"y",), (b"x" * 8190 + "€".encode(),), (b"x" * 8189 + "😀".encode(),), (b"x" * 8000 + b"\xff" + b"x" * 300,), (b"x\xc3",)], "c binary")
    assert [tuple(r) for r in d.select(files.is_text(F.col("c")), files.is_utf8_text(F.col("c"))).collect()] == [(True, True)] * 3 + [(False, False)] * 2


def test_scores_leave_a_task_only_as_its_best(spark, sf):
    for name in ("search_bm25", "prf_requery", "stem_match"):
        p = entry.queries()[name](spark, sf)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "Join" not in p and p.count("Exchange") <= (name == "search_bm25")


def test_scores_in_rows_equal_scores_of_postings(spark, tmp_path):
    texts = ["a b", "a b", "b c a", "", None, "c c c x", "a b", "K\u212a", "x \u0130y", "b", "zz"] * 3
    d = spark.createDataFrame([(i, f"n{i:02d}", t) for i, t in enumerate(texts)], "doc_id long, name string, text string").repartition(3)
    q = spark.createDataFrame([(1, "a b b q"), (2, "c kk"), (3, "i y"), (4, "nothing")], "query_id long, text string")
    stats = index.corpus_stats(d, "doc_id")
    for key in ("doc_id", "name"):
        docs = d.select(F.col(key).alias("doc_id"), "text", F.lit("/").alias("path"))
        posted = index.postings(docs, "doc_id")
        want = rank.bm25(q, posted, index.document_frequency(posted), stats)
        for k in (2, 100):
            assert rows(plan.Engine(docs).rank(q, "bm25", k).toPandas(), ["query_id", "doc_id", "score", "rank"]) == rows(rank.top_k(want, k).toPandas(), ["query_id", "doc_id", "score", "rank"])
        assert rows(plan.Engine(docs).scored(q).toPandas(), ["query_id", "doc_id", "score"]) == rows(want.toPandas(), ["query_id", "doc_id", "score"])
    keys = q.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"), F.lit(1.0).alias("weight"))
    posted = index.postings(d, "doc_id")
    want = rank.match_bm25(keys, posted, index.document_frequency(posted), index.row_stats(d)).withColumn("g", F.col("doc_id") % 2)
    got = plan.Engine(d).matched(keys, None, 2, F.col("doc_id") % 2, 2).withColumn("g", F.col("doc_id") % 2)
    best = lambda x: x.withColumn("r", F.expr("row_number() over (partition by query_id, g order by score, doc_id)")).filter("r <= 2").toPandas()
    assert rows(best(got), ["query_id", "doc_id", "score", "r"]) == rows(best(want), ["query_id", "doc_id", "score", "r"])


def test_passages_are_found_inside_longer_words(spark):
    d = spark.createDataFrame([(1, "before the long passage after"), (2, "xbefore the longy"), (3, "none"), (4, None)], "doc_id long, text string")
    got = {tuple(r) for r in in_rows.holding(d, [(1, "fore the lon"), (2, "the"), (3, "!"), (4, None)], "bigint").collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_stems_in_rows_equal_stems_of_postings(spark):
    d = spark.createDataFrame([(1, "He runs daily, run"), (2, "a running cat"), (3, "rune"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Running CATS"), (2, "")], "query_id long, text string")
    posted = index.postings(d, "doc_id").withColumn("stem", stem.stem(F.col("term")))
    assert {tuple(r) for r in rank.stem_match_rows(q, d).collect()} == {tuple(r) for r in rank.stem_match(q, posted, "doc_id").collect()} == {(1, 1, 1), (1, 2, 2)}


def test_postings_of_a_stored_index_are_blocks(spark, tmp_path):
    f = lambda *r: spark.createDataFrame([(p, len(t), m, t) for p, m, t in r], "path string, size long, mtime double, text string").repartition(2)
    many = [(f"/{i}.txt", 1.0, f"common w{i % 7} " + "many " * (i * 9) + "end") for i in range(40)]
    ix = Index(spark, f"file://{tmp_path}/ix").build(f(*many))
    assert spark.read.parquet(f"{ix.root}/postings").count() < ix.postings().count() / 2  # a row for a term of a block, not of a chunk
    ix.refresh(f(*many[:10], *((p, 2.0, t + " other common") for p, _, t in many[10:20]))).remove(f(*many[:2]).select("path")).sweep(f(*many[:30]).select("path"))
    for again in range(2):
        chunks, posted, t = ix.chunks(), ix.postings(), ix.totals().first()
        want = index.postings(chunks.select("chunk_id", "text"))
        assert rows(posted.toPandas(), ["chunk_id", "term", "tf", "dl"]) == rows(want.toPandas(), ["chunk_id", "term", "tf", "dl"])
        assert rows(ix.vocabulary().toPandas(), ["term", "df", "cnt"]) == rows(index.document_frequency(want).toPandas(), ["term", "df", "cnt"])
        assert {r.stem for r in posted.filter("term = 'many'").collect()} == {"mani"} and t.rows == chunks.count() and t.n == 28
        q = spark.createDataFrame([(1, "common many"), (2, "w3 other"), (3, "none")], "query_id long, text string")
        plain = rank.bm25(q, posted.withColumnRenamed("chunk_id", "doc_id"), ix.vocabulary(), ix.totals())
        assert rows(plan.Engine.of(ix).rank(q, "bm25", 5).toPandas(), ["query_id", "doc_id", "score", "rank"]) == rows(rank.top_k(plain, 5).toPandas(), ["query_id", "doc_id", "score", "rank"])
        ix.compact()
