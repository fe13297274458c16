import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparloom.llm import leakage, mixing, pairs, q_leakage, q_mixing, q_pairs, q_residue, q_scans, residue, scans
from sparloom.llm.boosting import Boosted

MODULES = [q_leakage, q_mixing, q_pairs, q_residue, q_scans]


@pytest.mark.parametrize("name, module", [(n, m) for m in MODULES for n in sorted(m.QUERIES)])
def test_queries_run(spark, small, name, module):
    module.QUERIES[name](spark, small).count()


# ---- leakage

ITEM = "The pump ABC_1 must restart within 30 seconds after the valve closes and before the tank is emptied by hand completely"


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id bigint, tpl int")
    return d, spark.createDataFrame(items, "item_id bigint, text string, suite string")


def test_leaks(spark):
    w = ITEM.split(" ")
    docs = [(1, ITEM.upper(), 5, 1), (2, "x " + "-".join(w[3:15]) + "; y", 5, 1), (3, " ".join(w[3:14]), 5, 1), (4, None, 5, 1), (5, "", 5, 1), (None, ITEM, 5, 1), (6, ITEM.replace("pump", "fan"), 5, 1), (1, ITEM, 5, 1)]
    items = [(10, ITEM, "s"), (11, "too short", "s"), (12, None, "s"), (None, ITEM, "s")]
    d, i = found(spark, docs, items)
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect() if r.item_id}
    assert got == {(1, 10), (2, 10), (6, 10)}
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_reparameterised(spark):
    def text(a, b, c, word="then"):
        return f"To obtain the level of the pump set the outer valve to {a} and wait until the tank shows {b} on the main panel {word} compare the level once more with {c} and report it to the gateway of the plant before the pump is stopped by hand again"

    item = text(5, 5, 8)
    docs = [(1, text(7, 7, 9)), (2, item), (3, text(7, 9, 9)), (4, text(7, 9, 6)), (5, text(7, 7, 9, "later")), (6, "so it is " + text(31, 31, 40) + " and so on"), (7, None), (8, "")]
    d, i = found(spark, [(k, t, 0, 0) for k, t in docs], [(10, item, "s"), (11, None, "s")])
    got = {r.doc_id: r.words for r in leakage.reparameterised(d, i).collect()}
    n = len(leakage.words(item))
    assert got[1] == got[6] == n and set(got) == {1, 5, 6}
    # One changed word: the longer half counts.
    at = leakage.words(item).index("then")
    assert got[5] == max(at, n - at - 1)
    assert leakage.reparameterised(d.limit(0), i).count() == 0 and leakage.reparameterised(d, i.limit(0)).count() == 0


# ---- mixing

BPE = q_mixing.TOKENIZER


def test_temperature():
    s = {"a": 0.7, "b": 0.2, "c": 0.1}
    t = mixing.temperature(s, {}, {}, 0, target_entropy=1.0)
    assert abs(mixing.entropy(mixing.temper(s, t)) - 1.0) < 1e-6
    assert mixing.temperature(s, {"a": 70, "b": 20, "c": 10}, {"a": 1, "b": 1, "c": 1}, 100) == 1.0
    assert math.isclose(sum(mixing.temper(s, 0.3).values()), 1.0)


def test_temper_tokens():
    rows = [{"source": k, "tokens": n, "max_repeats": m, "target_share": t} for k, n, m, t in (("a", 900, 1, 0.4), ("b", 90, 9, 0.3), ("c", 10, 20, 0.3), ("d", 0, 1, 0.0))]
    free = {r["source"]: r for r in mixing.temper_tokens(rows, 0.5)}
    assert abs(mixing.entropy({k: r["weight"] for k, r in free.items()}) - 0.5) < 1e-6 and 0 < free["a"]["exponent"] < 1 and free["d"]["weight"] == 0
    # The entropy of the targets asks for more repeats than there are: the limit decides.
    tight = {r["source"]: r for r in mixing.temper_tokens([dict(r, max_repeats=2) for r in rows])}
    assert max(r["passes"] for r in tight.values()) == pytest.approx(2, abs=1e-6) and tight["a"]["exponent"] > free["a"]["exponent"]
    once = mixing.temper_tokens([dict(r, max_repeats=1) for r in rows])
    assert all(r["weight"] == pytest.approx(r["token_share"]) for r in once) and mixing.temper_tokens([]) == []


def test_mix(spark):
    docs = [(i, "word " * 10, " Big ", 1) for i in range(300)] + [(1000 + i, "word " * 10, "small", 1) for i in range(10)] + [(2000, None, None, 1), (2001, "", "small", 1), (2002, "word " * 10, "none", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, tokens int")
    t = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 3), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    plan = {r.source: r for r in mixing.mix_plan(d, t, BPE).collect()}
    assert plan["small"].short and not plan["big"].short and plan["small"].passes == 3 and plan["gone"].passes == 0
    mix = mixing.realise(d, mixing.mix_plan(d, t, BPE), BPE)
    uses = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert all(uses[1000 + i] == 3 for i in range(10)) and max(uses.values()) == 3
    share = {r.source: r.actual_share for r in mixing.actual_shares(d, t, BPE).collect()}
    assert abs(sum(share.values()) - 1) < 1e-9
    assert mixing.mix_plan(d.limit(0), t, BPE).where("short").count() == 0 and mixing.mix_plan(d, t.limit(0), BPE).count() == 0


# ---- pairs

GOOD = ["The valve opens when the pump is idle.", "The valve closes when the tank is empty."] * 20


@pytest.mark.parametrize(
    "q, a, want",
    [
        ("What opens here?", None, ["empty_answer"]), ("What opens here?", " ​", ["empty_answer"]), ("What?", "N/A", ["empty_answer"]), ("What?", "k. A.", ["empty_answer"]), ("What?", "暂无", ["empty_answer"]), ("What?", "0", []), ("What?", "0x4C", []),
        ("Why is it so?", "I am sorry, but I cannot help with this request.", ["refusal"]), ("Warum?", "Leider kann ich dazu keine Auskunft geben.", ["refusal"]), ("为什么？", "抱歉，恕我不能协助处理。", ["refusal"]), ("Why?", "I cannot stress enough that order matters.", []), ("Why?", "The pump cannot accept a value above 5.", []),
        ("Which valve opens when the pump is idle?", "which valve opens when the pump is idle", ["copies_question"]), ("Which valve opens when idle?", "Which valve opens when idle? The main valve opens when the pump is idle.", []),
        ("Which?", '{"a": 1, "b": [', ["truncated"]), ("Which?", '{"a": 1}', []), ("When does it open?", "The valve opens when the pump is", ["truncated"]), ("When does it open?", "The valve opens when the pump is idle", []), ("When?", "The valve (see clause 8.1, where the pump is idle.", ["truncated"]), ("When?", "The valve opens when the...", ["truncated"]),
        ("When does the valve open and is it shut?", "Das Ventil öffnet sich, wenn die Pumpe steht und der Tank voll ist.", ["wrong_language"]), ("When does the valve open and is it shut? Please answer in German.", "Das Ventil öffnet sich, wenn die Pumpe steht und der Tank voll ist.", []),
        (None, "The valve opens when the pump is idle.", []),
    ],
)
def test_defects(spark, q, a, want):
    rows = [(str(i), "Q?", t, None) for i, t in enumerate(GOOD)] + [("x", q, a, None)]
    df = spark.createDataFrame(rows, "qa_id string, question string, answer string, instruction string")
    assert sorted(r.defect for r in pairs.broken_pairs(df).collect() if r.qa_id == "x") == want


def test_every_triggered_defect_comes_out(spark):
    rows = [("1", "Why is it so?", "I cannot provide that because the (", None), ("2", "Which valve opens when the pump is idle?", "Which valve opens when the pump is idle? (", None)]
    df = spark.createDataFrame(rows, "qa_id string, question string, answer string, instruction string")
    assert {tuple(r) for r in pairs.broken_pairs(df).collect()} == {("1", "refusal"), ("1", "truncated"), ("2", "copies_question"), ("2", "truncated")}


def test_keys_of_positions():
    """Keys depend on the sentence alone, not on what stands beside it."""
    p = pairs.Positions()
    sents = [["the", "valve", "opens", "when", "the", "pump"], ["it"], ["valve", "opens"], ["the", "big", "valve", "opens", "when", "the", "pump"]]
    k, last = p.keys(sents)
    for i, s in enumerate(sents):
        alone, at = p.keys([s])
        assert (k[last[i] - len(s) + 1 : last[i] + 1] == alone).all() and at[0] == len(s) - 1
    # Runs of content words are one star: both frames end alike.
    assert k[last[0], 1] == k[last[3], 1] and k[last[0], 3] == k[last[3], 3] and k[last[1], 1] != k[last[2], 1]


def test_pairs_table(spark):
    rows = [("1", "Q?", None, None, "x"), ("1", "Q?", None, None, "x"), (None, "Q?", None, None, "x"), ("2", "Q?", "word " * 100_000 + ".", None, "x")]
    df = spark.createDataFrame(rows, "qa_id string, question string, answer string, instruction string, defect string")
    assert [tuple(r) for r in pairs.broken_pairs(df).collect()] == [("1", "empty_answer")]
    assert pairs.broken_pairs(df.limit(0)).count() == 0


# ---- residue


def test_residue(spark):
    real = "Values of AB_1 above 3 are clamped. The pump stops."
    docs = [
        (1, "Dear {{name}}, the order {{id}} is closed.\nTest {{a}} ended with {{b}}."), (2, "Dear {{x}}, the order {{y}} is closed.\nTest {{c}} ended with {{d}}."), (3, "# Title\n\nLorem ipsum dolor sit amet."), (4, "404 Not Found. The page could not be located."),
        (5, "Home / Docs\nPlease enable JavaScript to view this page."), (6, f'{real}\n\nThe portal shows "please enable JavaScript" on old consoles.\n\n{real}'), (7, f"{real}\n{real}\nYour text here."), (8, f"# T\n\n{real}\n\nYour text here."),
        (9, None), (10, ""), (None, "404 Not Found. The page is gone."), (11, f"In the wiki ${{name}} stands for a name.\n{real}"), (12, "The template {ab_1} gets the value of AB_1 before XY1.2 is sent."),
    ]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id bigint, text string, kind string, pos int")
    got = {r.doc_id: r.kind for r in residue.residue(df).collect()}
    assert got == {1: "placeholder", 2: "placeholder", 3: "filler", 4: "error_page", 5: "script_notice", 8: "filler"}
    assert {r.doc_id for r in residue.without_residue(df).collect()} == {6, 7, 9, 10, None, 11, 12}
    assert residue.residue(df.limit(0)).count() == 0


def test_slots_blanks_pages_and_fillers(spark):
    real = "Values of AB_1 above 3 are clamped. The pump stops."
    docs = [
        (1, "Dear {{CUSTOMER_NAME}}, the order {{ORDER_ID}} is closed."), (2, "Dear {{ CUSTOMER_NAME }}, the order {{ ORDER_ID }} is closed.\nTo {{ FIRST_NAME }} we say so again."), (3, "Name of the device: ____"), (4, "Terven tufeter amiqui orimitu lobrunec dosilter pravensil."),
        (5, f"# T\n\n{real}\nTerven tufeter amiqui orimitu lobrunec dosilter."), (6, "TRACEBACK: FAILURE IN VIEW EXPORT_BLOCK, REQUEST 85607B68"), (7, f"{real}\n{real}\nTerven tufeter amiqui orimitu lobrunec dosilter."),
        *[(20 + i, f"Internal server error.\nQuote the number {i} to the crew that runs this machine, please do it soon.") for i in range(3)], (30, "Internal server error.\nThe relay closes the valve and opens it once more when it is cold."), (31, "The converter fills {{NAME}} with the value of AB_1 before XY1.2 is sent."),
    ]
    got = {r.doc_id: r.kind for r in residue.residue(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: "placeholder", 2: "placeholder", 3: "placeholder", 4: "filler", 5: "filler", 6: "error_page", 20: "error_page", 21: "error_page", 22: "error_page"}


def test_early_out_changes_no_row(spark, monkeypatch):
    """Documents of two real lines are left out before any other test; without that the rows are the same."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {tuple(r) for r in residue.residue(docs).collect()}
    monkeypatch.setattr(residue, "real_lines", lambda text: F.lit(0))
    assert {tuple(r) for r in residue.residue(docs).collect()} == want and len(want) > 40


# ---- scans


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + (x[:, 1] > 0) > 0.5).astype(float)
    m = Boosted().fit(x[:400], y[:400])
    assert ((m.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.9


def test_look_cost():
    assert scans.look_cost("rnonitor", "monitor") == pytest.approx(0.2) and scans.look_cost("c0ntro1", "control") == pytest.approx(0.4)
    assert scans.look_cost("cat", "dog") >= 1 and scans.look_cost("same", "same") == 0


@pytest.mark.parametrize("line, want", [("- 5 -", ("", True, True)), ("vii", ("", True, True)), ("第3页", ("", True, True)), ("COPY  |  [7]", ("COPY", True, False)), ("A Title", ("A Title", False, False)), ("D-3", ("", True, True))])
def test_edge_line(line, want):
    assert scans.edge_line(line) == want


def book(spark):
    body = ["The monitor converts the reserved voltage when the counter wraps during harbour trials.", "Every controller publishes the averaged signal before the archive is rotated again.", "The low-power station restores the acknowledged segment under heavy load."]
    rows = []
    for f in range(12):
        for p in range(1, 6):
            text = [body[(f + p) % 3], body[(f + p + 1) % 3], body[p % 3]] if f % 2 else body
            lines = ([f"ICD-AB-{1000 + f} Message Catalogue"] if f < 6 else []) + text + ([f"- {p + 3} -"] if f < 6 else [])
            t = "\n".join(lines)
            if (f, p) == (0, 1):
                t = t.replace("monitor", "rnonitor").replace("reserved", "reser-\nved").replace("low-power", "low-\npower")
            rows.append((f * 10 + p, "p", f"f{f}.pdf", p, t, "text", t if p == 1 else None, 1))
    rows += [(900, "p", "x.pdf", None, None, "text", None, 1), (901, "p", "x.pdf", None, " \n", "text", None, 1), (902, None, None, None, "alone", None, None, 1), (None, "p", "x.pdf", 1, "The rnonitor", "text", None, 1), rows[0]]
    return spark.createDataFrame(rows, "block_id bigint, project_id string, file_name string, page_num int, content string, block_type string, cleaned_content string, word int")


def test_noise_and_repair(spark):
    b = book(spark)
    got = {(r.block_id, r.field, r.noise) for r in scans.noise(b).collect()}
    assert {(f, n) for i, f, n in got if i == 1} == {(f, n) for f in ("content", "cleaned_content") for n in ("hyphenation", "misread", "running_header", "page_number")}
    assert {n for i, f, n in got if i == 2} == {"running_header", "page_number"}
    assert not [g for g in got if g[0] >= 60]
    text = {r.block_id: r.text for r in scans.repaired(b).collect()}
    assert text[1].startswith("The monitor converts the reserved voltage") and "low-power" in text[1] and "ICD" not in text[1] and not re.search(r"- 4 -", text[1])
    assert text[900] is None and text[902] == "alone"


def test_empty_blocks(spark):
    assert scans.noise(book(spark).limit(0)).count() == 0 and scans.repaired(book(spark).limit(0)).count() == 0
