"""Transactions on versioned folders and the change feed as a stream."""

from __future__ import annotations

import pytest

from palimpsest.operators.store import ConflictError, Store
from palimpsest.streaming import feed


def test_transactions(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.version() is None
    roots = lambda n: spark.createDataFrame([(1, n)], "proot long, txn_id long")
    first = s.commit({"proots": roots(1)})
    assert s.version() == first and s.read("proots").first().txn_id == 1
    s.commit({"proots": roots(1)}, expected=roots(1))
    assert s.read("proots").first().txn_id == 2  # the store counts, whatever the writer says
    with pytest.raises(ConflictError):
        s.commit({"proots": roots(1)}, expected=roots(1))
    with pytest.raises(ConflictError):
        s.commit({"proots": roots(1)}, expected=spark.createDataFrame([(7, 1)], "proot long, txn_id long"))
    assert s.read("proots").first().txn_id == 2
    s.clear()
    assert s.read("proots").count() == 0


def test_only_one_of_two_writers_commits(spark, tmp_path, monkeypatch):
    """Both read version 1 and pass the check; the second to claim version 2 fails and leaves nothing to read."""
    one, two = (Store(spark, f"file://{tmp_path}/store") for _ in range(2))
    roots = spark.createDataFrame([(1, 1)], "proot long, txn_id long")
    one.commit({"proots": roots})
    claim = Store._claim

    def late(self, path):
        if self is two and "_claims" in path:
            one.commit({"proots": roots}, expected=roots)
        return claim(self, path)

    monkeypatch.setattr(Store, "_claim", late)
    with pytest.raises(ConflictError):
        two.commit({"proots": roots}, expected=roots)
    assert one.version() == two.version() == "00000002" and one.read("proots").first().txn_id == 2
    assert sorted(x.name for x in (tmp_path / "store").iterdir() if not x.name.startswith(("_", "."))) == ["00000001", "00000002"]


def test_feed_stream_equals_batch(spark, tmp_path):
    rows = [(1, 5, 0), (1, 4, 1), (2, 1, 2), (1, 6, 3), (2, 1, 4), (2, 3, 5), (1, 6, 6)]
    df = spark.createDataFrame(rows, feed.FEED)
    want = sorted(map(tuple, feed.fresh(df).collect()))
    assert want == [(1, 5, 0), (1, 6, 3), (2, 1, 2), (2, 3, 5)]
    for k in (0, 1):
        df.where(f"seq >= {3 * k} and seq < {3 * k + 3 + 9 * k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feed.fresh_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("fresh_feed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("select * from fresh_feed").collect())) == want


def test_graph_files_and_attachments(spark, tmp_path):
    import hashlib

    from palimpsest.functions import codec
    from palimpsest.sources import interchange

    u = "00000000-0000-4000-8000-0000000000%02x"
    items = [{"id": u % 1, "attrs": {"name": (3, "root"), "parts": (38, [u % 2]), "raw": (4, b"\1")}}, {"id": u % 2, "attrs": {"name": (3, None)}}]
    for folder, body in (("bin", codec.graph_to_binary(u % 1, items)), ("json", codec.graph_to_json(u % 1, items).encode())):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a").write_bytes(body)
    want = {(u % 1, "name", 3, "root", None), (u % 1, "parts", 38, None, (u % 2,)), (u % 1, "raw", 4, "AQ==", None), (u % 2, "name", 3, None, None)}
    for folder, form in (("bin", "binary"), ("json", "json")):
        got = interchange.read_graphs(spark, str(tmp_path / folder), form).collect()
        assert {(r.item, r.attr, r.type, r.val, tuple(r.vals) if r.vals is not None else None) for r in got} == want
        assert {r.root for r in got} == {u % 1}
    (tmp_path / "bin" / "b").write_bytes((tmp_path / "bin" / "a").read_bytes())
    found = interchange.import_attachments(spark, str(tmp_path / "bin")).collect()
    assert [r.attachment for r in found] == [hashlib.sha1((tmp_path / "bin" / "a").read_bytes()).hexdigest()]
    assert interchange.import_attachments(spark, str(tmp_path / "bin"), spark.createDataFrame([(found[0].attachment,)], "attachment string")).count() == 0
