"""Stored payloads go through a row filter, so that reading them back undoes one."""

import zlib

from gridframe.llm import media


def test_stored_rows_are_filtered(spark):
    texts = ["", "some words", "ö" * 500, "many words of a text " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.as_media(df).collect():
        raw = zlib.decompress(b"".join(body for kind, body in media.chunks(bytes(r.media)) if kind == b"IDAT"))
        assert set(raw[:: media.ROW + 1]) == {1}
        assert media.decode(bytes(r.media)).tobytes().rstrip(b" ") == texts[r.doc_id].encode().rstrip(b" ")
