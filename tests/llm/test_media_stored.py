"""The media query goes through stored bytes; damaged files give a reason."""

import hashlib


def test_media_bytes_are_stored_and_reread(spark, tmp_path):
    from treefold.llm.media import payload_digests, texts_as_media
    from treefold.llm.queries import op4_media_columns

    docs = spark.createDataFrame([(1, "one text"), (2, None), (None, "x" * 100_000), (3, "")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op4_media_columns(spark, str(tmp_path))
    files = got.inputFiles()
    assert files and not any("documents.parquet" in f for f in files)
    stored = spark.read.parquet(*files)
    assert {"doc_id", "n_bytes", "media", "tracks", "error"} == set(stored.columns)
    plain = payload_digests(texts_as_media(docs))
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    media = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    for r in got.collect():
        text = {1: "one text", None: "x" * 100_000}.get(r["doc_id"], "").encode()
        frames = max(1, -(-len(text) // 64))
        assert r["codec"] == "raw " and r["seconds"] == frames / 25 and len(r["key_frames"]) == -(-frames // 25)
        assert r["media_bytes"] == len(media[r["doc_id"]]) and r["media_sha256"] == hashlib.sha256(media[r["doc_id"]]).hexdigest()
        for i, k in enumerate(r["key_frames"]):
            frame = media[r["doc_id"]][k["offset"] : k["offset"] + k["length"]]
            assert frame == (text + bytes(64))[i * 25 * 64 :][:64] and k["time"] == i


def test_equal_texts_have_equal_values(spark, tmp_path):
    from treefold.llm.queries import op4_media_columns

    spark.createDataFrame([(i, ["same text", None, "", "other"][i % 4]) for i in range(40)], "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    found = {}
    for r in op4_media_columns(spark, str(tmp_path)).collect():
        found.setdefault(r["payload_sha256"], set()).add((r["payload_bytes"], r["tail_crc32"], r["media_bytes"], r["media_sha256"], r["feature"]))
    assert len(found) == 3 and all(len(v) == 1 for v in found.values())


def track(stsz=None, stts=(1, 1, 1), stsc=(1, 1, 1, 1), stco=(1, 8)):
    from treefold.llm import media as m

    words = lambda *x: b"".join(v.to_bytes(4, "big") for v in x)
    boxes = [m.full_box(b"stts", words(*stts)), m.full_box(b"stsc", words(*stsc)), m.full_box(b"stco", words(*stco)), m.full_box(b"stsz", stsz or words(0, 1, 4))]
    return m.box(b"ftyp", b"isom") + m.box(b"moov", m.box(b"trak", m.box(b"mdia", m.box(b"minf", m.box(b"stbl", *boxes)))))


def test_damaged_files_give_a_reason(spark):
    """Deep nesting, counts beyond the file, ranges outside it, headers without a body: an error each, and no memory taken."""
    from treefold.llm import media as m

    words = lambda *x: b"".join(v.to_bytes(4, "big") for v in x)
    deep = b""
    for _ in range(3000):
        deep = m.box(b"moov", deep)
    huge = 2**32 - 1
    bad = {
        "deep": deep,
        "sizes": track(stsz=words(64, huge)),
        "times": track(stts=(1, huge, 1), stsz=words(0, 2, 1, huge)),
        "chunks": track(stsc=(1, 1, huge, 1), stco=(1, huge)),
        "outside": track(stco=(1, 10_000)),
        "no hdlr": m.box(b"ftyp") + m.box(b"moov", m.box(b"trak", m.box(b"mdia", m.box(b"hdlr"), m.box(b"mdhd")))),
    }
    assert m.probe(track())[0].samples()[0].tolist() == [8]
    many = track(stts=(1, huge, 7), stsc=(1, 1, huge, 1))
    assert [x.tolist() for x in m.probe(many)[0].samples()] == [[8], [4], [0]]  # large counts that one sample does not use
    df = spark.createDataFrame(list(bad.items()), "name string, media binary")
    got = {r["name"]: r for r in m.media_columns(df).collect()}
    assert all(got[n]["tracks"] is None and got[n]["error"] for n in bad), {n: got[n]["error"] for n in bad}


def test_fragmented_files_are_not_taken_for_empty_ones(spark):
    from treefold.llm import media as m

    stbl = m.box(b"stbl", *(m.full_box(k, bytes(4)) for k in (b"stts", b"stsc", b"stco")), m.full_box(b"stsz", bytes(8)))
    moov = m.box(b"moov", m.box(b"trak", m.box(b"mdia", m.box(b"minf", stbl))), m.box(b"mvex"))
    moof = m.box(b"moof", m.box(b"traf", m.full_box(b"tfhd", bytes(4)), m.full_box(b"trun", (1).to_bytes(4, "big"))))
    file = m.box(b"ftyp", b"isom") + moov + moof + m.box(b"mdat", b"frames")
    (row,) = m.media_columns(spark.createDataFrame([(file,)], "media binary")).collect()
    assert row["tracks"] is None and "fragments" in row["error"]
