"""Posting lists are made inside tasks: nothing but packages is kept uncompressed, and lists are those of the terms."""

from pyspark.sql import functions as F

from quillstack.functions import terms
from quillstack.operators.lineage import cut, folders
from quillstack.plans import index as I


def test_a_write_keeps_no_texts_or_terms_but_as_parquet_and_lists_what_the_terms_are(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(I, "TOGETHER", 200)
    rows = [(i, f"p{i % 3}", f"{i % 2}.0", " ".join(f"word{(i * k) % 17}" for k in range(i % 9)), None if i % 5 else f"head{i % 4}") for i in range(700)]
    entries = spark.createDataFrame(rows, "entry_id long, package string, version string, text string, name string").repartition(3)
    kept = []

    def counted(df):
        found = cut(df)
        kept.append(found.count())
        return found

    monkeypatch.setattr(I, "cut", counted)
    index = I.Index(spark, str(tmp_path / "index"))
    index.write(entries, {"text": 2}, {"name": 1})
    assert max(kept) <= 6  # packages
    whole = terms.vectors(entries, {"body": {"text": 2}, "head": {"name": 1}})
    expected = {(r.entry_id, g, t.term, r[f"{n}_len"], t.tf) for r in whole.collect() for g, n in enumerate(("body", "head")) for t in r[f"{n}_terms"]}
    table = index.at().table("postings")
    listed = [(r, p) for r in table.collect() for p in r["list"]]
    assert {(p.entry_id, r.g, r.term, p.len, p.tf) for r, p in listed} == expected and len(listed) == len(expected)
    assert all((r.package, r.version) == (f"p{p.entry_id % 3}", f"{p.entry_id % 2}.0") for r, p in listed)
    assert table.filter(F.col("bucket") != I.bucket(F.col("term"))).isEmpty()
    assert index.at().entries().select("entry_id", "text", "name").exceptAll(entries.select("entry_id", "text", "name")).isEmpty() and index.at().entries().count() == 700
    assert not any(f.startswith("index-pass") for f in folders(spark, str(I.shared_folder(spark))))
