"""What the operators once left out."""

from sparloom.llm import mixing, q_mixing, residue, scans

BODY = ["The monitor converts the reserved voltage when the counter wraps during harbour trials.", "Every controller publishes the averaged signal before the archive is rotated again.", "The receiver restores the acknowledged segment under heavy load."]


def pages(spark, of):
    """One block a page: five files of four pages, ``of(file, page)`` gives the lines."""
    rows = [(f * 10 + p, "p", f"f{f}.pdf", p, "\n".join(of(f, p)), "text", None) for f in range(1, 6) for p in range(1, 5)]
    return spark.createDataFrame(rows, "block_id bigint, project_id string, file_name string, page_num int, content string, block_type string, cleaned_content string")


def test_furniture_of_three_lines(spark):
    b = pages(spark, lambda f, p: ["DRAFT FOR COMMENT", f"Extended Watchdog Catalogue Rev. {f}.1", str(p + 1), *BODY, "7", "9", "Printed Copies Are Uncontrolled", "Northern Harbour Authority", "Orlink Working Group"])
    got = {(r.block_id, r.noise) for r in scans.noise(b).collect()}
    assert {(f * 10 + p, n) for f in range(1, 6) for p in range(1, 5) for n in ("running_header", "page_number")} <= got
    text = {r.block_id: r.text for r in scans.repaired(b).collect()}
    # All three lines at the top and three at the bottom go; one number a page edge: of 7 and 9 the outer one.
    assert text[11].startswith("The monitor") and text[11].endswith("7") and "Printed" not in text[11]


def test_no_walk_past_the_body(spark):
    lines = [*BODY, "Spare Lines"]
    assert [x[:3] for x in scans.edge_lines("\n".join(["A Title", BODY[0], "Other Title", *lines]))] == [("A Title", 0, None), ("Spare Lines", None, 0)]
    long = "\n".join(["Top Title Here", "Second Title Here", "Third Title Here", "12", *BODY * 30])
    assert [x[1] for x in scans.edge_lines(long)] == [0, 1, 2, 3]


def kinds(spark, docs):
    return {r.doc_id: r.kind for r in residue.residue(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}


def test_unfilled_template_of_one_fill(spark):
    form, opening = "Dear {{name}}, the order {{id}} is closed.", "The pump of the eastern harbour stops when the valve is closed."
    remark = "In the wiki the notation ${name} stands for the name of the pump."
    assert kinds(spark, [(1, form)]) == {1: "placeholder"}
    copies = [(i, form) for i in range(20)] + [(100 + i, f"{opening}\n\n{form}") for i in range(20)]
    assert kinds(spark, copies) == {i: "placeholder" for i, _ in copies}
    # Remarks about a notation and single lines beside real text are text, however often they are repeated.
    assert kinds(spark, [(i, f"{opening}\n{remark}") for i in range(20)] + [(50, remark), (51, f"{opening}\n{form}")]) == {}


def sizes(total, **of):
    return [{"source": k, "target_share": s, "max_repeats": r, "tokens": n, "total": total} for k, (s, r, n) in of.items()]


def test_weights_are_shares_of_the_mix():
    # c can't reach 0.3 within its limit: the others take the rest in proportion to their targets.
    plan = {r["source"]: r for r in mixing.plan_mix(sizes(1000, a=(0.4, 4, 500), b=(0.3, 4, 450), c=(0.3, 2, 50)))}
    assert [round(plan[k]["weight"], 6) for k in "abc"] == [round(0.9 * 4 / 7, 6), round(0.9 * 3 / 7, 6), 0.1] and plan["c"]["short"]
    assert abs(sum(r["passes"] * r["tokens"] for r in plan.values()) - 1000) < 1e-6 and plan["c"]["passes"] == 2
    # A flatter mix keeps every limit: the bisected exponent is applied.
    plan = {r["source"]: r for r in mixing.plan_mix(sizes(1000, a=(0.8, 1, 600), b=(0.2, 2, 400)))}
    assert plan["a"]["exponent"] < 1 and abs(plan["a"]["weight"] - 0.6) < 1e-6 and abs(plan["b"]["weight"] - 0.4) < 1e-6
    # Too little text altogether: all are at their limits.
    plan = mixing.plan_mix(sizes(1000, a=(0.5, 1, 100), b=(0.5, 1, 300)))
    assert [round(r["weight"], 6) for r in plan] == [0.25, 0.75] and {r["passes"] for r in plan} == {1.0}


def test_token_budget_of_skewed_documents(spark):
    docs = [(i, "word " * 10, "a") for i in range(60)] + [(100, "word " * 300, "a")] + [(1000 + i, "word " * 10, "b") for i in range(90)] + [(2000, "word " * 10, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 0.25, 2), ("b", 0.75, 3)], "source string, target_share double, max_repeats int")
    plan = mixing.mix_plan(d, t, q_mixing.TOKENIZER)
    tok = {r.doc_id: r.tokens for r in mixing.with_tokens(d, q_mixing.TOKENIZER).collect()}
    for seed in (1, 2):
        mix = mixing.realise(d, plan, q_mixing.TOKENIZER, seed).collect()
        for r in plan.collect():
            used = sum(tok[x.doc_id] for x in mix if x.source == r.source)
            assert 0 <= r.passes * r.tokens - used <= max(tok[0], 11)
            assert max(x.repeat for x in mix if x.source == r.source) <= r.max_repeats
