"""Ids that no floating-point number holds, with a null id in the same batch."""

import public_tokenizers

from skilltide.llm import bpe, jaccard, pii, warc
from skilltide.llm.exact import without_copies

IDS = [(1 << 60) + 1, (1 << 60) + 3, None, (1 << 62) + 7]
TEXT = " ".join(f"word{i}" for i in range(40))


def docs(spark, texts):
    return spark.createDataFrame(list(zip(IDS, texts)), "doc_id long, text string").coalesce(1)


def test_ids_of_documents(spark):
    table = docs(spark, ["mail a@example.com", "one 10.0.0.1", "x", ""])
    for result in (bpe.digests(table, public_tokenizers.path("byte_bpe_50k.json")), pii.personal_data(table)):
        assert {r["doc_id"] for r in result.collect()} == set(IDS)
    assert {r["doc_id"] for r in without_copies(table).collect()} == set(IDS)


def test_classes_of_near_copies(spark):
    rows = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_links(
        docs(spark, [TEXT, TEXT, "other words", TEXT + " more"])).collect()}
    assert rows == {IDS[0]: (IDS[0], 2), IDS[1]: (IDS[0], 2), None: (None, 0), IDS[3]: (IDS[0], 2)}
    kept = jaccard.without_near_copies(docs(spark, [TEXT, TEXT, "other words", TEXT + " more"]))
    assert {r["doc_id"] for r in kept.collect()} == {IDS[0], None}


def test_revisits(spark):
    html = "<p>" + "x" * 200
    pages = spark.createDataFrame(
        [(IDS[1], "http://a/", html), (IDS[0], "http://a/", html), (None, "http://a/", html), (IDS[3], None, "")],
        "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archived(pages).collect()}
    assert got == {IDS[0]: ("response", None), IDS[1]: ("revisit", IDS[0]), None: ("revisit", IDS[0]),
                   IDS[3]: ("response", None)}
