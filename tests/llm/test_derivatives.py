"""Links, digests and text of derived records."""

import gzip
import hashlib

from foldwise.llm.derivatives import derived_records, write_records

SCHEMA = "record_id string, target_uri string, date string, content_type string, payload string, block string, warc_type string"
PAGE = """<!DOCTYPE html><html lang="fr"><head><title>Un &amp; <b>deux</b>
</title><style>p{}</style><SCRIPT>var t="</p>";</SCRIPT ></head>
<body><!-- a <b> --><p>x &lt; y&nbsp;&copy; z</p>a<br>b <a href="/1">l</a><A class=k HREF='2'>m</A> 3 < 4 &eacute;</body></html>"""


def sha(text):
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_records_are_linked_and_keep_the_source(table):
    responses = table([("<urn:a>", "http://é/", "2026", "text/html", PAGE, "own", "own")], SCHEMA)
    found = {row["warc_type"]: row for row in derived_records(responses).collect()}
    assert set(found) == {"metadata", "conversion"}
    for row in found.values():
        assert (row["refers_to"], row["target_uri"], row["date"]) == ("<urn:a>", "http://é/", "2026")
        assert row["source_payload_digest"] == sha(PAGE) and row["source_content_length"] == len(PAGE.encode())
        assert row["block_digest"] == sha(row["block"]) and row["content_length"] == len(row["block"].encode())
        assert row["record_id"].startswith("<urn:uuid:") and row["record_id"] != row["refers_to"]
    assert found["conversion"]["block"] == "Un & deux\nx < y ©z".replace("©z", "© z") + "\na\nb lm 3 < 4 &eacute;"
    lines = dict(line.split(": ", 1) for line in found["metadata"]["block"].strip().split("\r\n"))
    assert (lines["title"], lines["language"], lines["outlinks"]) == ("Un & deux", "fr", "2")
    assert lines["source-payload-digest"] == sha(PAGE)


def test_ids_are_stable_and_repeats_stay(table):
    rows = [("<urn:a>", "u", "d", "t", "x", "", "")] * 2 + [("<urn:b>", "u", "d", "t", "x", "", "")]
    ids = sorted(row["record_id"] for row in derived_records(table(rows, SCHEMA)).collect())
    assert len(ids) == 6 and len(set(ids)) == 4
    assert ids == sorted(row["record_id"] for row in derived_records(table(rows, SCHEMA).repartition(3)).collect())


def test_missing_values_and_no_rows(table):
    responses = table([(None,) * 7], SCHEMA)
    rows = derived_records(responses).collect()
    assert len(rows) == 2 and all(row["refers_to"] == "" and row["source_payload_digest"] == sha("") for row in rows)
    assert [row["block"] for row in rows if row["warc_type"] == "conversion"] == [""]
    assert derived_records(responses.limit(0)).count() == 0


def test_written_records_can_be_cut_apart_by_their_lengths(table, tmp_path):
    rows = [("<urn:a>", "u", "d", "t", PAGE, "", ""), ("<urn:b>", "u", "d", "t", "é\n\n<p>two", "", "")]
    records = derived_records(table(rows, SCHEMA))
    write_records(records, str(tmp_path / "out"))
    data = b"".join(gzip.decompress(path.read_bytes()) for path in sorted((tmp_path / "out").glob("part-*")))
    blocks = []
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        size = int(dict(line.split(": ", 1) for line in lines[1:])["Content-Length"])
        blocks.append(data[:size].decode())
        assert data[size : size + 4] == b"\r\n\r\n"
        data = data[size + 4 :]
    assert sorted(blocks) == sorted(row["block"] for row in records.collect())
