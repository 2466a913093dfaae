import re
from hashlib import sha256

from quern.llm import decontaminate
from quern.llm.decontaminate import contamination, drop_contaminated, remove_spans

DOCS, ITEMS = "doc_id long, text string, items string, k int", "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
ITEM_ROWS = [(1, PASSAGE), (2, "short item"), (10, PASSAGE + " thirteen"), (3, ""), (4, None), (5, "!!"), (1, PASSAGE)]
DOC_ROWS = [
    (1, f"before {PASSAGE.upper()}, after", "i", 1),
    (2, "a short item and a SHORT-item", "i", 1),
    (3, "one two three four five six seven eight nine", "i", 1),
    (4, None, "i", 1),
    (5, "", "i", 1),
    (6, "ünï short itemé", "i", 1),
    (7, f"{PASSAGE} {PASSAGE}", "i", 1),
    (8, "one two three four five six seven eight nine ten " * 100, "i", 1),
    (9, "clean words only", "i", 1),
]


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(text):
    w, hit, items = words(text), set(), set()
    for item, t in ITEM_ROWS:
        x = words(t)
        k = min(10, len(x))
        for i in range(len(x) - k + 1) if k else ():
            for j in range(len(w) - k + 1):
                if w[j : j + k] == x[i : i + k]:
                    hit |= set(range(j, j + k))
                    items.add(str(item))
    return len(w), len(hit), len(items), sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit), hit


def test_against_brute_force(spark):
    docs, items = spark.createDataFrame(DOC_ROWS, DOCS), spark.createDataFrame(ITEM_ROWS, ITEMS)
    found = {r.doc_id: r for r in contamination(docs, items).collect()}
    assert len(found) == len(DOC_ROWS)
    for i, t, *_ in DOC_ROWS:
        r, want = found[i], brute(t)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[:5], i
        assert {p for s in r.spans for p in range(s["at"], s["to"])} == want[5]


def test_documents_and_spans_are_removed(spark):
    docs, items = spark.createDataFrame([*DOC_ROWS, DOC_ROWS[-1]], DOCS), spark.createDataFrame(ITEM_ROWS, ITEMS)
    clean = drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6, 9, 9]


ANY_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    """The text without its hit words and what stands before each of these."""
    if text is None:
        return None
    hit, out, at = brute(text)[5], "", 0
    for p, m in enumerate(ANY_WORD.finditer(text)):
        out += "" if p in hit else text[at : m.end()]
        at = m.end()
    return out + text[at:]


def test_spans_are_cut_from_the_text_as_it_is(spark):
    rows = [*DOC_ROWS, (10, f"Keep  THIS, {PASSAGE}! And\nthat.", "i", 1), (10, "Another text (same id).", "i", 1), (None, f"{PASSAGE}?", "i", 1), (11, "Two SHORT items: short item, Short-Item; end", "i", 1)]
    docs, items = spark.createDataFrame([*rows, rows[0]], DOCS).repartition(3), spark.createDataFrame(ITEM_ROWS, ITEMS)
    left = remove_spans(docs, items)
    assert left.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, ((i, cut(t)) for i, t, *_ in [*rows, rows[0]])))
    assert {r.text for r in left.where("doc_id = 9").collect()} == {"clean words only"}
    assert [r.text for r in left.where("doc_id = 10 and text like 'Keep%'").collect()] == ["Keep  THIS! And\nthat."]


def test_beyond_the_broadcast(spark, monkeypatch):
    docs, items = spark.createDataFrame([*DOC_ROWS, DOC_ROWS[0]], DOCS), spark.createDataFrame(ITEM_ROWS, ITEMS)
    key = lambda rows: sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, str(r.spans)) for r in rows)
    want, clean = key(contamination(docs, items).collect()), sorted(r.doc_id for r in drop_contaminated(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", 3)
    assert key(contamination(docs, items).collect()) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_SPANS", 0)
    assert sorted(r.doc_id for r in drop_contaminated(docs, items).collect()) == clean
    assert {(r.doc_id, r.text) for r in remove_spans(docs, items).collect()} == {(i, cut(t)) for i, t, *_ in DOC_ROWS}


def test_clashing_columns(spark):
    rows = [(1, f"x {PASSAGE} y", "a", 2, "w", 3, "h"), (2, "clean", "a", 2, "w", 3, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, rid int, words string, text_key int, spans string")
    items = spark.createDataFrame([(*r, "z") for r in ITEM_ROWS], ITEMS + ", items string")
    assert [tuple(r) for r in drop_contaminated(docs, items).collect()] == [rows[1]]
    assert sorted(tuple(r) for r in remove_spans(docs, items).collect()) == [(1, "x y", *rows[0][2:]), rows[1]]
    assert {r.doc_id: r.n_hit for r in contamination(docs, items).collect()} == {1: 12, 2: 0}


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame(ITEM_ROWS, ITEMS)
    docs, no_items = spark.createDataFrame(DOC_ROWS, DOCS), spark.createDataFrame([], ITEMS)
    assert contamination(none, items).collect() == []
    assert not any(r.contaminated for r in contamination(docs, no_items).collect())
    assert drop_contaminated(docs, no_items).count() == len(DOC_ROWS)
    assert remove_spans(none, items).collect() == []
    assert {(r.doc_id, r.text) for r in remove_spans(docs, no_items).collect()} == {(i, t) for i, t, *_ in DOC_ROWS}
