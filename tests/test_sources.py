import json

from proseline.sources import readers, writers


def test_outputs_and_fallback(spark, tmp_path):
    (tmp_path / "outputs.jsonl").write_text('{"model": "m", "text": "x", "length_target": [1, 2]}\n\n{"model": "n", "error": "e"}\n')
    found = readers.scored_or_outputs(spark, str(tmp_path)).collect()
    assert [(r.model, r.text, r.error) for r in found if r.model] == [("m", "x", None), ("n", None, "e")]


def test_baseline_takes_numbers_and_structs(spark, tmp_path):
    (tmp_path / "stats.json").write_text(json.dumps({"tells_per_1k_words": {"delve": 0.5, "reach_out": {"pooled_rate_per_1k_words": 1.5}}}))
    found = readers.baseline(spark, str(tmp_path / "stats.json"), "email").collect()
    assert {r.tell: r.human_rate for r in found} == {"delve": 0.5, "reach_out": 1.5}


def test_text_files_fall_back_to_latin_1(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.txt").write_bytes("é".encode("latin-1"))
    assert [r.text for r in readers.text_files(spark, str(tmp_path)).collect()] == ["é", "é"]


def test_chat_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text(
        "<root><message><ts>2020-01-01T00:00:00</ts><user> u </user><text>hi</text></message>"
        "<message><ts>bad</ts><user>u</user><text>no</text></message><message><ts>2020-01-01T00:00:01</ts><user>u</user></message></root>"
    )
    assert [(r.author, r.text) for r in readers.chat_xml(spark, str(tmp_path / "c.xml")).collect()] == [("u", "hi")]


def test_votes_drop_malformed_lines(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"t": 1, "w": "a", "l": "b"}\nnot json\n{"t": 2, "w": "b", "l": "a"}\n')
    assert [r.t for r in readers.votes(spark, str(tmp_path / "v.jsonl")).orderBy("seq").collect()] == [1, 2]


def test_corpus_writer_numbers_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", 1) for i in (5, 3, 9, 1)], "pos int, text string, words int")
    writers.corpus(df, str(tmp_path / "out"), "doc", "pos")
    found = readers.clean_corpus(spark, str(tmp_path / "out")).orderBy("id").collect()
    assert [(r.id, r.text) for r in found] == [("doc-000001", "t1"), ("doc-000002", "t3"), ("doc-000003", "t5"), ("doc-000004", "t9")]


def test_scenarios_prompts_and_plan(spark, tmp_path):
    thread = [{"from": "recipient", "text": "hi"}, {"from": "persona", "text": "yes"}, {"from": "someone", "text": "x"}]
    pack = [{"id": "email.1", "domain": "email", "persona": "P", "recipient": "R", "context_thread": thread, "prompt": "Write.", "length_target": {"words": [1, 2]}}, {"id": "email.2", "domain": "email", "persona": "Q", "prompt": "Go."}]
    (tmp_path / "email.json").write_text(json.dumps(pack))
    (tmp_path / "slack.json").write_text(json.dumps([{"id": "slack.1", "domain": "slack", "persona": "S", "recipient": "", "context_thread": [], "prompt": "Say."}]))
    found = readers.scenarios(spark, str(tmp_path))
    told = {r.id: r.prompt for r in readers.prompts(found).collect()}
    assert told["email.1"] == 'About me: P\nWho this is going to: R\nThey wrote: "hi"\nI previously wrote: "yes"\nContext: "x"\n\nWrite.'
    assert (told["email.2"], told["slack.1"]) == ("About me: Q\n\nGo.", "About me: S\n\nSay.")
    plan = readers.generation_plan(spark.createDataFrame([("m",), ("n",)], "model string"), found, 3).collect()
    assert len(plan) == 2 * 3 * 3 and {r.sample for r in plan} == {0, 1, 2}
    assert readers.scenarios(spark, str(tmp_path / "none")).count() == 0


def test_setups_and_maps(spark, tmp_path):
    (tmp_path / "setups.json").write_text('{"email.1": "a", "email.2": "b"}')
    known = readers.setups(spark, str(tmp_path / "setups.json"))
    found = readers.with_setups(spark.createDataFrame([("email.1",), ("x",)], "scenario string"), known).collect()
    assert {r.scenario: r.setup for r in found} == {"email.1": "a", "x": ""}
    flat = spark.createDataFrame([(["a", "1", "b", "2", "a", "3", "odd"],), ([],), (None,)], "flat array<string>")
    assert [r.flat for r in readers.pairs_to_map(flat).collect()] == [{"b": "2", "a": "3"}, {}, {}]


def test_post_corpus_reads_one_column(spark, tmp_path):
    spark.createDataFrame([("t", 1)], "text string, other int").write.parquet(str(tmp_path / "p"))
    found = readers.post_corpus(spark, str(tmp_path / "p"))
    assert found.columns == ["text"] and [r.text for r in found.collect()] == ["t"]


def test_reports_and_snapshots(spark, tmp_path):
    from datetime import UTC, datetime

    df = spark.createDataFrame([(3, "c", None), (1, "a", 1.25), (2, "b", 2.0)], "n int, name string, x double")
    writers.json_lines(df, str(tmp_path / "lines"), ["n"])
    parts = sorted((tmp_path / "lines").glob("part-*"))
    assert [json.loads(x)["n"] for p in parts for x in p.read_text().splitlines()] == [1, 2, 3]
    writers.report(df, str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("part-*"))) == 1
    funnel = spark.createDataFrame([(1, "a", 0, 5), (2, "b", 2, 3)], "number int, stage string, dropped long, kept long")
    assert writers.funnel_map(funnel).first().funnel == {"1_a": 5, "2_b": 3}
    path = writers.snapshot(df, str(tmp_path), datetime(2026, 1, 2, 3, 4, tzinfo=UTC))
    assert path.endswith("votes-20260102-0304.jsonl") and spark.read.json(path).count() == 3
    text = writers.console_table(df.select("name", "n", "x"), ["n"], width=6, first=5)
    assert text.splitlines() == ["name      n     x", "a         1   1.2", "b         2   2.0", "c         3   n/a"]
