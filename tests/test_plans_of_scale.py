"""Plans: what is broadcast, and what is dealt anew."""

import re

import pytest

from tandem.operators import linkage as K
from tandem.plans import catalog
from tandem.sources import fixtures as D
from tandem.sources import nested

SF = "/root/testdata/sf0.001"


def broadcast_parts(plan: str) -> list[str]:
    """What stands below each broadcast of an explained plan."""
    lines, found = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth, below = line.index("BroadcastExchange"), []
            for x in lines[i + 1 :]:
                if not re.match(r"[\s:|+-]*$", x[:depth]):
                    break
                below.append(x)
            found.append("\n".join(below))
    return found


@pytest.mark.parametrize("name", ["label_similarity", "orphan_caption", "display_labels", "result_cards", "strong_weak"])
def test_questions_are_not_broadcast(spark, capsys, name):
    """Ten rows are made of each order, so their size is not that of the orders."""
    catalog.QUERIES[name](spark, SF).explain()
    assert not any("explode(" in part for part in broadcast_parts(capsys.readouterr().out))


def test_sessions_are_dealt_once(spark, capsys):
    """Neither the questions nor the tables in buckets of sessions are dealt again by session and further columns."""
    a = catalog._answers(spark, SF)
    K.by_label(K.keyed(D.questions(spark, SF)), K.groups(a)).explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(o_orderkey" in plan and "hashpartitioning(session_id" not in plan
    catalog._mappings(spark, SF, a).explain()
    dealt = re.findall(r"Exchange hashpartitioning\([^)]*\), (\w+)", capsys.readouterr().out)
    assert all(x == "REPARTITION_BY_COL" for x in dealt)


def test_runs_and_blocks_are_dealt_once(spark, capsys):
    """What anchors are made of stays dealt by session up to the anchors themselves."""
    from tandem.operators import geometry as G

    D.text_runs(spark, SF).explain()
    assert "Union" not in capsys.readouterr().out
    runs = catalog.by_key(G.ordered_runs(D.text_runs(spark, SF)), "runs")
    runs.join(catalog.by_key(D.blocks(spark, SF), "blocks").hint("merge"), "session_id").explain()
    assert "Exchange" not in capsys.readouterr().out


@pytest.mark.parametrize("name", ["result_cards", "orphan_caption", "summary", "highlight_boxes"])
def test_only_labels_are_broadcast(spark, capsys, monkeypatch, name):
    """Tables of sessions and what is made of them have millions of rows in small files; of no step they may go through the driver."""
    from tandem.sources import tables

    def shown(write):
        return lambda df, *more: df.explain() or write(df, *more)

    monkeypatch.setattr(K, "by_key", shown(tables.by_key))
    monkeypatch.setattr(K, "written", shown(tables.written))
    catalog.QUERIES[name](spark, SF).explain()
    parts = broadcast_parts(capsys.readouterr().out)
    assert parts and all("spelled" in part for part in parts)


def test_parts_grow_with_the_rows(spark, capsys, monkeypatch):
    """A table that is dealt once has parts of about the same size, however large it is, and still is dealt once."""
    from tandem.sources import tables

    monkeypatch.setattr(tables, "ROWS_OF_PART", 500)
    n = D.parts(spark, SF)
    assert n > 4 and n == tables.parts_of(spark, 500 * n) == tables.parts_of(spark, 500 * n - 499)
    assert tables.parts_of(spark, 4 * 500) is None
    a = catalog._answers(spark, SF)
    m = catalog._mappings(spark, SF, a)
    m.explain()
    plan = capsys.readouterr().out
    assert {int(x) for x in re.findall(r"SelectedBucketsCount: \d+ out of (\d+)", plan)} == {n}
    assert set(re.findall(r"Exchange hashpartitioning\(\w+#\w+, (\d+)\), (\w+)", plan)) == {(str(n), "REPARTITION_BY_NUM")}
    rows = sorted(repr(r) for r in K.orphans(m, a).collect())
    monkeypatch.undo()
    b = catalog._answers(spark, SF)
    assert rows == sorted(repr(r) for r in K.orphans(catalog._mappings(spark, SF, b), b).collect())


#: Queries that are made of mappings, each with its own last step.
OF_MAPPINGS = ["merge_answers", "orphans", "grade_length", "unanswered", "grade_lookup", "consumed_ids", "badge_tiers", "needs_review", "score_mapping"]


@pytest.mark.parametrize("name", OF_MAPPINGS)
def test_all_steps_of_mappings_grow_in_parts(spark, capsys, monkeypatch, name):
    """From the answers to a query's last step, what is dealt by session is in parts of bounded size, and dealt once."""
    from tandem.sources import tables

    monkeypatch.setattr(tables, "ROWS_OF_PART", 1000)
    n = str(D.parts(spark, SF))
    write = tables.by_key
    for module in (catalog, K):
        monkeypatch.setattr(module, "by_key", lambda df, *more, **named: df.explain() or write(df, *more, **named))
    catalog.QUERIES[name](spark, SF).explain()
    plans = capsys.readouterr().out
    assert set(re.findall(r"SelectedBucketsCount: \d+ out of (\d+)", plans)) == {n}
    dealt = re.findall(r"Exchange hashpartitioning\((?:session_id|[lo]_orderkey)#[^)]*, (\d+)\), (\w+)", plans)
    assert dealt and set(dealt) == {(n, "REPARTITION_BY_NUM")}


def test_nested_orders_are_dealt_once(spark, capsys, monkeypatch):
    """Lines and orders are dealt by file; numbering, records, their join and the lists use that."""
    write = nested.write_lists
    monkeypatch.setattr(nested, "write_lists", lambda rows, path, *more: nested.lists(rows, *more).explain() or write(rows, path, *more))
    catalog.QUERIES["nested_orders"](spark, SF)
    dealt = re.findall(r"Exchange (\w+)\((\w+)#\w+, \d+\), (\w+)", capsys.readouterr().out)
    assert dealt == [("hashpartitioning", "file", "REPARTITION_BY_COL")] * 2
