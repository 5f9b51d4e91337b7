"""Comment titles against a plain edit distance."""

import random

import pytest

from lettermark.operators.linkage import fuzzy_title_links

SCHEMA = "paper_id bigint, doi string, journal_id bigint, year int, original_title string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, edits):
    for _ in range(edits):
        at, kind = rng.randrange(len(text) + 1), rng.randrange(3)
        text = text[:at] + (rng.choice("abc") if kind else "") + text[at + (kind != 1) :]
    return text


@pytest.mark.parametrize("most", [1, 4])
def test_links_equal_edit_distance(spark, most):
    rng = random.Random(most)
    titles = ["".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 3, 5, 6, 9, 14, 30]))) for _ in range(60)]
    wanted = [edited(rng, rng.choice(titles), rng.randrange(7)) for _ in range(250)]
    wanted = [w for w in wanted if w]
    data = [(i, f"o{i}", 1, 2005, t) for i, t in enumerate(titles)] + [(1000 + i, f"c{i}", 1, 2005, f"Comment on {w}") for i, w in enumerate(wanted)]
    everyone = [(d, t.lower()) for _, d, _, _, t in data]
    want = {(d, f"c{i}") for i, w in enumerate(wanted) for d, t in everyone if distance(w, t) <= most}
    got = [tuple(r) for r in fuzzy_title_links(spark.createDataFrame(data, SCHEMA), 1, most).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_titles_make_few_pieces_in_many_tasks(spark):
    data = [(i, f"o{i}", 1, 2005, f"{i:030d}") for i in range(300)] + [(1000, "c", 1, 2005, f"Comment on {7:030d}")]
    out = fuzzy_title_links(spark.createDataFrame(data, SCHEMA), 1)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "REPARTITION_BY_NUM" in text
    assert not [line for line in text.splitlines() if "BroadcastHashJoin [want_len" in line]  # pieces reached the driver before

    def made(node):
        rows = [node.metrics().apply("numOutputRows").value()] if node.nodeName() == "Generate" else []
        below = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.child()] if node.nodeName() == "ReusedExchange" else []
        kids = node.children()
        return rows + [r for x in (*below, *(kids.apply(i) for i in range(kids.size()))) for r in made(x)]

    assert max(made(plan)) <= 85 * 302  # 405 a title before
