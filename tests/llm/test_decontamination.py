import random

import pyarrow as pa
import pytest
from helpers import CLASHING, LONG, ROWS, SAME, empty, table, ugly

from codeloom.llm import decontamination as D

ITEM = "A farmer named Alice has 12 apples and sells 5 apples to Robert for 3 dollars each before the long market day ends. How many apples are left in the basket?"
OTHER = "A farmer named Maria has 40 apples and sells 9 apples to Victor for 7 dollars each before the long market day ends. How many apples are left in the basket?"
MIXED = "A farmer named Maria has 40 apples and sells 9 apples to Victor for 7 dollars each before the long market day ends. How many pears are left in the crate?"


def filler(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def pairs(docs, items):
    return {(r.doc_id, r.item_id) for r in D.report(docs, items).collect()}


@pytest.fixture()
def items(spark):
    return table(spark, [(1, ITEM), (2, SAME), (3, "too short"), (4, None), (5, "five words are just enough")], id_name="item_id")


def test_verbatim_and_re_parameterised_questions(spark, items):
    docs = table(spark, [(1, filler(50) + ". " + ITEM), (2, OTHER), (3, filler(200)), (4, "x " + SAME.upper()), (5, MIXED + " " + filler(30))], CLASHING)
    got = pairs(docs, items)
    assert {(1, 1), (2, 1), (4, 2), (5, 1)} == got
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [3]


def test_slots_must_agree(spark):
    text = "Take {} cups of flour and mix well with water then take {} spoons of salt and wait for {} long days while stirring the bowl with care each single night"
    items = table(spark, [(1, text.format(3, 3, 3))], id_name="item_id")
    same, differ = text.format(7, 7, 7), text.format(7, 8, 9)
    got = D.report(table(spark, [(1, same), (2, differ)]), items).collect()
    assert {r.doc_id for r in got} == {1} and got[0].consistent == 1.0


def test_names_and_units_are_placeholders():
    import pyarrow as pa

    _, kind, _ = D.templates(pa.array(["Then Bob ran 3.5 km in twenty minutes. Bob stopped."]))
    assert kind.tolist() == [0, 2, 0, 1, 3, 0, 1, 3, 0, 0]


def test_windows_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    import pyarrow as pa

    def tokens(text):
        w, kind, _ = D.templates(pa.array([text]))
        return list(zip(w.hash.tolist(), (kind > 0).tolist()))

    def grams(t, n):
        return {tuple(h for h, _ in t[k : k + n]): k for k in range(len(t) - n + 1) if sum(s for _, s in t[k : k + n]) <= D.MOST_SLOTS * n}

    lists = {r.item_id: tokens(r.text) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        t = tokens(r.text)
        for i, x in lists.items():
            n = min(D.WINDOW, len(x))
            if n < D.LEAST_TOKENS:
                continue
            all_ = [tuple(h for h, _ in x[k : k + n]) for k in range(len(x) - n + 1) if sum(s for _, s in x[k : k + n]) <= D.MOST_SLOTS * n]
            own = grams(t, n)
            if all_ and sum(g in own for g in all_) / len(all_) >= D.LEAST_COVERAGE:
                want.add((r.doc_id, i))
    got = pairs(docs, bench)
    assert got <= want and len(got) >= 0.95 * len(want) and got  # the rest fails the slots' consistency


def test_benchmark_in_parts_gives_the_same(spark, items):
    docs = table(spark, [(1, ITEM), (2, SAME), (3, filler(99))])
    whole = pairs(docs, items)
    parts = list(D.indexes(items, part=20))
    assert len(parts) > 2
    found = set()
    import pyarrow as pa

    for p in parts:
        found |= {(d + 1, p.ids[i]) for d, i, *_ in D._match(p, pa.array([ITEM, SAME, filler(99)]))}
    assert found == whole == {(1, 1), (2, 2)}


def test_defined_results(spark, items):
    got = pairs(ugly(spark), items)
    assert got == {(5, 2), (6, 2), (None, 2)}
    assert D.report(ugly(spark), items).count() == 3  # repeated rows once
    assert sorted(str(r.doc_id) for r in D.clean(ugly(spark), items).collect()) == sorted(str(i) for i, t in ROWS if t != SAME)
    assert D.report(empty(spark), items).count() == 0
    none = table(spark, [], id_name="item_id")
    assert D.report(ugly(spark), none).count() == 0 and D.clean(ugly(spark), none).count() == len(ROWS)
    long_item = table(spark, [(9, LONG)], id_name="item_id")
    assert pairs(ugly(spark), long_item) == {(4, 9)}


def test_null_item_id_is_reported(spark):
    items = table(spark, [(None, SAME)], id_name="item_id")
    assert pairs(table(spark, [(1, SAME)]), items) == {(1, None)}


WEEK = "On Monday the shop sold 3 red apples for 2 dollars each. On Tuesday the shop sold 5 red apples for 4 dollars each. On Friday the shop sold 8 red apples for 6 dollars each."


def test_each_occurrence_is_judged_alone(spark):
    items = table(spark, [(1, ITEM), (2, WEEK)], id_name="item_id")
    apart = " ".join(ITEM.split()[:16]) + " " + filler(90) + " " + " ".join(ITEM.split()[16:])
    got = pairs(table(spark, [(1, ITEM + " " + OTHER), (2, f"{filler(40)}. {OTHER} {filler(9)}. {ITEM}"), (3, WEEK), (4, f"{WEEK} {WEEK.replace('3', '7')}"), (5, apart)]), items)
    assert got == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 1)}


def test_row_is_that_of_one_occurrence(spark):
    items = table(spark, [(1, ITEM)], id_name="item_id")
    n = len(D.templates(pa.array([ITEM]))[1])
    r = D.report(table(spark, [(1, ITEM + " " + OTHER)]), items).collect()
    assert [(x.first_token, x.end_token, x.coverage, x.consistent) for x in r] == [(0, n, 1.0, 1.0)]


SHORT = "Alice has 12 apples. Alice sells 5 to Robert. How many apples does Alice have?"


def test_names_that_begin_sentences_may_change(spark):
    items = table(spark, [(1, SHORT), (2, 'Mary buys 4 pens and 6 books for the school. "Peter pays," says Mary. Peter has 9 coins left after that.')], id_name="item_id")
    docs = [
        (1, SHORT), (2, "Maria has 40 apples. Maria sells 9 to Victor. How many apples does Maria have?"), (3, "Once McDonald has 40 apples. McDonald sells 9 to Victor. How many apples does McDonald have?"),
        (4, filler(30) + '.\n"Jane buys 7 pens and 8 books for the school. "Oscar pays," says Jane. Oscar has 3 coins left after that.'), (5, "Maria has 40 apples. Nina sells 9 to Victor. How many apples does Paula have?"),
        (6, "maria has 40 apples. maria sells 9 to victor. how many pears does maria lack?"),
    ]
    assert pairs(table(spark, docs), items) == {(1, 1), (2, 1), (3, 1), (4, 2)}


def test_capitals_within_a_name():
    assert D.templates(pa.array(["Then McDonald met NASA and LeBron"]))[1].tolist() == [0, 2, 0, 0, 0, 2]


def test_items_of_placeholders_are_found_verbatim(spark):
    table_ = "3 4 5 6 7 8 9 10 11 12"
    items = table(spark, [(1, "What is 3 + 4 * 12 - 6?"), (2, table_), (3, ITEM)], id_name="item_id")
    docs = [(1, "What is 3 + 4 * 12 - 6?"), (2, f"{filler(20)} what is 3 + 4 * 12 - 6 {filler(20)}"), (3, "What is 5 + 9 * 11 - 2?"), (4, f"rows: {table_} and so on"), (5, "1 2 7 8 9 10 20 30 40 50"), (6, OTHER)]
    assert pairs(table(spark, docs), items) == {(1, 1), (2, 1), (4, 2), (6, 3)}
    assert {r.doc_id for r in D.clean(table(spark, docs), items).collect()} == {3, 5}
