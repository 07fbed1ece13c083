"""search_deep returns every match, whatever their number."""

from pyspark.sql import functions as F

from harrow.plans import catalogue
from harrow.plans import search as plans


def test_every_match(spark, folder, monkeypatch):
    asked = []
    search = plans.search
    monkeypatch.setattr(plans, "search", lambda *a, **b: asked.append(b.get("k", 0)) or search(*a, **b))
    rows = catalogue.search_deep(spark, folder).collect()
    index = catalogue.documents_index(spark, folder)
    wanted = index.postings.filter(F.col("term").isin("the", "and", "tion")).select("doc_id").distinct().count()
    assert asked == [None]
    assert sorted(r["rank"] for r in rows) == list(range(1, wanted + 1))
