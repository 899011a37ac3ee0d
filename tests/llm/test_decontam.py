import re

from pyspark.sql import functions as F

from slotpack.llm import decontam

from .conftest import prose

ITEMS = "item_id long, text string"


def _words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def test_passages_are_found_and_nothing_else(spark, frame):
    items = [(k, prose(900 + k, 20 + k).capitalize() + ".") for k in range(6)]
    rows = []
    for i in range(60):
        text = prose(i, 80)
        if i % 5 == 0:
            body = items[i % 6][1]
            text = f"{text}. {body.upper() if i % 10 == 0 else body}\n{prose(i + 3000, 30)}"
        rows.append((i, text))
    truth = {(i, k) for i, t in rows for k, x in items if f" {' '.join(_words(x))} " in f" {' '.join(_words(t))} "}
    bench = spark.createDataFrame(items, ITEMS).withColumn("hash", F.lit(1)).withColumn("size", F.lit("s"))
    got = decontam.matches(frame(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth
    assert all(r.exact and r.windows >= r.item_windows - 2 for r in got)
    kept = decontam.drop_contaminated(frame(rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in rows} - {i for i, _ in truth})
    assert kept.columns == frame(rows).columns


QUESTION = "the farmer Maria buys 12 apples at the market and sells 5 kg of them before 12 people arrive home"


def test_other_numbers_names_and_units_are_caught_when_consistent(spark, frame):
    bench = spark.createDataFrame([(1, QUESTION)], ITEMS)
    same = QUESTION.replace("Maria", "Jonas").replace("12", "30").replace("5 kg", "7 lbs")
    shape = QUESTION.replace("12 apples", "30 apples").replace("12 people", "31 people")  # one item value, two values here
    got = {r.doc_id: r for r in decontam.matches(frame([(1, QUESTION), (2, same), (3, shape)]), bench).collect()}
    assert got[1].exact and not got[2].exact and got[2].windows == got[1].windows == got[1].item_windows
    assert 3 not in got or got[3].windows < got[1].windows
    same_values = "add 1, 2, 3, 4 and 5, 6, 7, 8 or 9"  # mostly slots: found with its own values only
    other = same_values.replace("2", "17")
    items = spark.createDataFrame([(1, same_values)], ITEMS)
    assert [(r.doc_id, r.exact) for r in decontam.matches(frame([(1, same_values), (2, other)]), items).collect()] == [(1, True)]


def template_words(spark, text):
    own = decontam.with_names(decontam.spaced(decontam.numbered(F.lit(text))))
    row = spark.range(1).select(decontam.words(decontam.template(F.lower(own))).alias("t"),
                                decontam.words(F.lower(own)).alias("v")).first()
    return row.t, row.v


def test_templates(spark):
    t, v = template_words(spark, "Then Anna paid 12 km and 3.5% to Mary\n Ann Lee. Next Day 1,200 MILES")
    assert t == ["then", "0name", "paid", "0num", "0unit", "and", "0num", "0unit", "to", "0name", "next", "0name", "0num", "0unit"]
    assert v == ["then", "0nameanna", "paid", "0num12", "0unitkm", "and", "0num3p5", "0unitpercent", "to", "0namemary0nameann0namelee",
                 "next", "0nameday", "0num1200", "0unitmiles"]
    assert template_words(spark, "x2 a,b 5kg v1.2.3 no 7, 8")[0] == ["x2", "a", "b", "0num", "0unit", "v1p2p3", "no", "0num", "0num"]


def found(spark, frame, docs, items):
    return {(r.doc_id, r.item_id) for r in decontam.matches(frame(docs), spark.createDataFrame(items, ITEMS)).collect()}


CAPITAL = "What is the capital city of France and how many people live there"
SHORT_ITEMS = [(1, "What is 12 + 7 - 5 * 3 + 9 / 2"), (2, "Who painted Mona Lisa"), (3, "Name the 5 largest oceans"), (4, CAPITAL)]


def test_copies_are_found_whatever_their_case_and_spacing(spark, frame):
    docs, want = [], set()
    for i, item in SHORT_ITEMS:
        for k, copy in enumerate([item, item.lower(), item.upper(), item.title(), "\n ".join(item.split()), item.replace(" ", "  ")]):
            docs.append((10 * i + k, f"{prose(10 * i + k, 30)}.\n{copy}?\n{prose(700 + 10 * i + k, 30)}"))
            if not (k == 4 and i == 2):  # a short item broken over lines fills none of them
                want.add((10 * i + k, i))
    assert found(spark, frame, docs, SHORT_ITEMS) == want


def test_stock_phrases_and_parts_of_sentences_are_no_copies(spark, frame):
    items = [(1, "Which of the following is true of the following statements about the boiling point of water at sea level"),
             *SHORT_ITEMS]
    docs = [(1, f"{prose(1, 20)} which of the following is true of the following {prose(2, 20)}"),
            (2, "They asked who painted Mona Lisa and went home"), (3, f"what is the capital city of {prose(3, 30)}"),
            (4, "What is 13 + 7 - 5 * 3 + 9 / 2")]
    assert found(spark, frame, docs, items) == set()


def test_half_of_an_item_or_a_long_run_is_a_match(spark, frame):
    item, long = prose(61, 40), prose(62, 120)
    docs = [(1, f"{prose(5, 20)} {' '.join(item.split()[:26])} {prose(6, 20)}"), (2, f"{' '.join(item.split()[:20])} {prose(7, 20)}"),
            (3, f"{prose(8, 20)} {' '.join(long.split()[50:76])}"), (4, " ".join(long.split()[50:70]))]
    assert found(spark, frame, docs, [(1, item), (2, long)]) == {(1, 1), (3, 2)}


def test_other_parameters_with_stated_recall_and_precision(spark, frame):
    """Items with numbers, names and units; copies with other ones are found, other texts of one shape are not."""
    items, docs, want = [], [], set()
    for k in range(30):
        a, b, c = (prose(2000 + 10 * k + j, 6) for j in range(3))
        ask = f"{a} Maria {b} {12 + k} km {c} Peter paid 1,{200 + k} dollars and Maria walked {12 + k} km"
        items.append((k, ask))
        docs.append((100 + k, ask.replace("Maria", "Mary Ann").replace("Peter", "Jo").replace(f"{12 + k} km", "95.5 miles")
                     .replace(f"1,{200 + k}", "77")))
        want.add((100 + k, k))
        d, e, f = (prose(9000 + 10 * k + j, 6) for j in range(3))
        docs.append((200 + k, f"{d} Maria {e} {12 + k} km {f} Peter paid 1,{200 + k} dollars and Maria walked {12 + k} km"))
    assert found(spark, frame, docs, items) == want  # recall and precision 1 on this set


def test_a_window_that_all_items_share_makes_no_pairs(spark, frame):
    stock = "please read the text and answer the question below in your own words"
    items = [(k, f"{stock} {prose(3000 + k, 20)}") for k in range(40)]
    docs = [(k, f"{stock} {prose(4000 + k, 30)}") for k in range(40)] + [(100, items[7][1])]
    assert found(spark, frame, docs, items) == {(100, 7)}


def test_short_items_and_edge_rows(spark, frame, edge_rows):
    items = [(1, "one plain text with some words and"), (2, "a"), (3, None), (4, ""), (5, "text without an id a"),
             (6, "a text without an id"), (7, "***")]
    bench = spark.createDataFrame(items, ITEMS)
    got = {(r.doc_id, r.item_id, r.windows) for r in decontam.matches(frame(edge_rows), bench).collect()}
    assert got == {(1, 1, 1), (None, 6, 1), (7, 2, 1), (8, 2, 1)}
    kept = decontam.drop_contaminated(frame(edge_rows), bench)
    assert kept.count() == len(edge_rows) - 2 - 2 - 2  # rows of ids 1, 7 and 8 and, told by id, both rows without one
    assert decontam.matches(frame([]), bench).collect() == []
    none = spark.createDataFrame([], ITEMS)
    assert decontam.matches(frame(edge_rows), none).collect() == []
    assert decontam.drop_contaminated(frame(edge_rows), none).count() == len(edge_rows)


def test_blocks_give_the_same(spark, frame, monkeypatch):
    bench = spark.createDataFrame([(k, prose(900 + k, 30)) for k in range(4)], ITEMS)
    docs = frame([(i, f"{prose(i, 20)} {prose(900 + i % 4, 30)}") for i in range(8)])
    whole = sorted(map(tuple, decontam.matches(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK", 20)
    assert sorted(map(tuple, decontam.matches(docs, bench).collect())) == whole and len(whole) == 8
