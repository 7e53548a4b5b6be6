"""Urls that hold line breaks and header texts change no other field of their record."""

import hashlib
import os

from tabforge.llm import warc


def test_line_breaks_in_urls(spark, tmp_dir):
    urls = ["http://a/", "http://b/\r\nWARC-Payload-Digest: sha256:00", "http://c/\r\nWARC-Refers-To: <urn:page:2:x:1>",
            "http://d/\n\n", None]
    pages = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    folder = os.path.join(tmp_dir, "warc-urls")
    warc.write_archive(pages, folder)
    got = {r.record_id.split(":")[2]: r for r in warc.read_records(spark, folder).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        r, body = got[str(i)], f"<p>{i}</p>".encode()
        assert bytes(r.payload) == body and r.payload_digest == hashlib.sha256(body).hexdigest()
        assert r.record_type == "response" and r.refers_to_record is None
        assert r.url == (u and u.replace("\r", "%0D").replace("\n", "%0A"))
