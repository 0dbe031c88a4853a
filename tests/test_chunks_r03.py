"""What windows carry to their reference."""

import __spark_entry__ as entry
from sitebag.operators import chunks as K

SF = "/root/testdata/sf0.001"


def test_windows_meet_the_reference_as_text_and_short_places(spark, monkeypatch):
    met = []
    real = K.with_reference
    monkeypatch.setattr(K, "with_reference", lambda rows, *more: met.append(rows) or real(rows, *more))
    entry.queries()["f1_chunk_table"](spark, SF)
    kinds = dict(met[0].dtypes)
    assert kinds["query"] == "string" and kinds["places"] == "array<int>"
    rejected = met[0].where("reject_reason is not null")
    assert rejected.where("window_start is not null").count() > 0
    assert rejected.where("signal is not null or query is not null or places is not null").count() == 0
    kept = met[0].where("reject_reason is null")
    assert kept.where("size(signal) <> 400 or length(query) <> size(places) or array_min(filter(places, p -> p >= 0)) <> 0").count() == 0
    assert kept.where("signal is null or query is null or places is null").count() == 0 < kept.count()
