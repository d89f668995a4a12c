"""Each id of near dedup meets its label once, with all its buckets."""

from assay.llm import near_dedup


def test_ids_meet_their_labels_once(spark, monkeypatch):
    seen, join = [], type(spark.range(1)).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "id" and how == "left":
            seen.append(out.count())
        return out

    members = spark.createDataFrame([(key, i, 0, 9) for key in range(4) for i in range(9)], "key long, id long, head long, size long")
    heads = spark.createDataFrame([(key, 0, 9) for key in range(4)], "key long, head long, size long")
    labels = spark.createDataFrame([(i, 0 if i < 5 else 5) for i in range(8)], "id long, label long")
    monkeypatch.setattr(type(members), "join", counted)
    rows = near_dedup.mixed_buckets(heads, members, labels).collect()
    assert seen[0] == 9
    want = {(key, i, 0 if i < 5 else 5 if i < 8 else 8, i >= 5) for key in range(4) for i in range(9)}
    assert {(r.key, r.id, r.comp, r.outside) for r in rows} == want and len(rows) == 36
