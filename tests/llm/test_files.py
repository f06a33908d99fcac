import hashlib
import math
import random
import re
import tarfile
import zlib
from collections import Counter

import pytest

from tests.llm.helpers import ODD_ROWS, odd_documents, write
from tracewell.llm import queries as q
from tracewell.llm.licenses import Index, words
from tracewell.llm.media import feature, from_png, png_header, store_media, to_png
from tracewell.llm.warc import decode_http, members, parse_records, read_archives, read_records, reassemble, write_archives


def pages(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("x"), "block": F.lit(1)})


def want_pages(rows):
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [r[0] for r in rows if r[0] is not None and (r[2] or "").encode() == raw]
        largest = max(same) if len(raw) >= 1000 and len(same) and len([r for r in rows if (r[2] or "").encode() == raw]) > 1 else None
        revisit = largest is not None and page_id != largest
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", largest if revisit else None))
    return sorted(out, key=str)


PAGES = [
    (1, "http://a/ü x", "<p>é</p>" * 400), (2, None, "<p>é</p>" * 400), (3, "http://c", None), (4, "http://d", ""), (5, "u", "short"), (6, "u", "short"),
    (7, "u", "\r\n\r\n0\r\n\r\nWARC/1.1\r\n" * 9000), (7, "u", "\r\n\r\n0\r\n\r\nWARC/1.1\r\n" * 9000), (None, "u", "<p>é</p>" * 400), (8, "u", "x" * 1000), (9, "u", "x" * 999), (10, "u", "x" * 1000),
]


@pytest.mark.parametrize("segment", [100, 32_768])
def test_warc_round_trip(spark, segment):
    folder = write_archives(pages(spark, PAGES), segment_bytes=segment)
    got = read_archives(spark, folder).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want_pages(PAGES)
    by_id = {r[0]: (r[2] or "").encode() for r in PAGES}
    assert all(bytes(r.payload) == by_id[r.page_id] for r in got if r.payload is not None)


def test_warc_whole_table_and_empty(spark, sf_dir, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in q.op6_warc_segments(spark, sf_dir).collect()), key=str) == want_pages(rows)
    assert q.op6_warc_segments(spark, write(spark, pages(spark, []), tmp_path, "pages")).count() == 0


def test_archive_files_are_members_with_mandatory_headers(spark):
    folder = write_archives(pages(spark, PAGES), segment_bytes=5000)
    found = [head for r in spark.read.parquet(f"{folder}/manifest").collect() for m in members(r.path) for head, _ in parse_records(m)]
    for head in found:
        assert {"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(head) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", head["warc-date"])
    responses = {h["warc-record-id"] for h in found if h["warc-type"] == "response"}
    revisits = [h for h in found if h["warc-type"] == "revisit"]
    assert revisits and all(h["warc-refers-to"] in responses for h in revisits)
    assert len({h["warc-record-id"] for h in found}) == len(found)


def test_lost_segments_are_noticed(spark):
    folder = write_archives(pages(spark, [(1, "u", "y" * 900)]), segment_bytes=100)
    records = read_records(spark, folder)
    assert reassemble(records).count() == 1
    for lost in (3, 1, 12):
        with pytest.raises(Exception, match="segments missing"):
            reassemble(records.where(f"number <> {lost}") if lost < 12 else records.where("total is null")).collect()


def test_records_and_chunks():
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\n\r\n\r\n\r\n\r\n"
    assert [b for _, b in parse_records(raw)] == [b"\r\n\r\n"]
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert decode_http(head + b"3;x=1\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") == b"abcde"
    with pytest.raises(ValueError):
        decode_http(head + b"3\r\nabcd\r\n0\r\n\r\n")


def check_media(rows, got):
    want = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(to_png(payload)), hashlib.sha256(to_png(payload)).hexdigest()))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert all((r.width, r.height, r.bit_depth) == (64, r.payload_bytes // 64, 8) for r in got)
    assert len({r.payload_sha256 for r in got}) >= len({(r.payload_sha256, r.feature) for r in got})


def test_media(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check_media(rows, q.op10_media_columns(spark, sf_dir).collect())
    check_media(ODD_ROWS, q.op10_media_columns(spark, write(spark, odd_documents(spark), tmp_path)).collect())
    assert q.op10_media_columns(spark, write(spark, odd_documents(spark, []), tmp_path / "e")).count() == 0


def test_media_shards_are_tar_files(spark):
    rows = store_media(odd_documents(spark)).collect()
    assert len({bytes(r.digest) for r in rows}) == len(rows)  # once in the whole corpus
    for r in rows:
        with tarfile.open(r.shard.removeprefix("file://")) as tar:
            assert len(tar.getnames()) == len(set(tar.getnames()))
            media = tar.extractfile(f"{r.digest.hex()}.png").read()
        assert len(media) == r.length and png_header(media[:33])[0] == 64
        assert hashlib.sha256(from_png(media).tobytes()).digest() == r.digest


def test_png_and_feature_are_what_they_say():
    """The stored form by another reader of PNG, and the feature by plain counting."""
    rng = random.Random(3)
    for payload in (bytes(64), bytes(rng.randrange(256) for _ in range(640)), b"ab" * 320):
        media, at, data = to_png(payload), 8, b""
        while at < len(media):
            size, kind = int.from_bytes(media[at : at + 4], "big"), media[at + 4 : at + 8]
            assert zlib.crc32(media[at + 4 : at + 8 + size]) == int.from_bytes(media[at + 8 + size : at + 12 + size], "big")
            data += media[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
            at += 12 + size
        lines = zlib.decompress(data)
        assert b"".join(lines[k + 1 : k + 65] for k in range(0, len(lines), 65)) == payload and not any(lines[::65])
        n = len(payload)
        mean = sum(payload) / n
        deviation = math.sqrt(sum((b - mean) ** 2 for b in payload) / n)
        bits = -sum(c / n * math.log2(c / n) for c in Counter(payload).values())
        bands = "/".join(str(sum(b // 32 == k for b in payload) * 1000 // n) for k in range(8))
        got = re.fullmatch(r"64x(\d+) mean=(.*) dev=(.*) bits=(.*) bands=(.*)", feature(from_png(media)))
        assert int(got[1]) == n // 64 and got[5] == bands
        assert all(abs(float(got[k]) - v) < 0.001 for k, v in ((2, mean), (3, deviation), (4, bits)))


def base_licenses(text):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in phrases.items() for i in range(len(found)) if found[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(found), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


LICENSED = [
    (1, "Licensed under the Apache License, Version 2.0.", "en", "a"),
    (2, "MIT License mit license\nGNU General-Public License and cc by, CC BY-NC", "en", "a"),
    (3, "x " * 5000 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "en", "a"),
    (4, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "en", "a"),
    (5, "this software is free of the charge that any person may bring to deal in the copies of a copy", "en", "a"),
    (6, "Licensed under CC BY-NC 4.0.", "en", "a"),
]


def test_licenses(spark, sf_dir, tmp_path):
    for k, rows in enumerate([[*ODD_ROWS, *LICENSED], spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]):
        d = sf_dir if k else write(spark, odd_documents(spark, rows), tmp_path)
        got = q.op8_license_scan(spark, d).collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(((r[0], *base_licenses(r[1])) for r in rows), key=str)
        assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
        if not k:
            labels = {r.doc_id: r.labels for r in got if r.n_words > 3 and r.doc_id in (1, 3, 4, 5, 6) and r.n_words not in (4, 20000)}
            assert labels == {1: "apache", 3: "mit", 4: "bsd", 5: "", 6: "cc-by,cc-by-nc"}
    assert q.op8_license_scan(spark, write(spark, odd_documents(spark, []), tmp_path / "e")).count() == 0


def test_rare_words_come_first():
    index = Index({"software": 900, "merge": 1}, 1000)
    assert index.idf[b"merge"] > index.idf[b"software"]
    assert words("É-A1_b".encode()) == ["É".encode(), b"a1", b"b"]
