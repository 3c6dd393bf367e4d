"""Chat formatting and archives: exact round trips, with the odd cases."""

import random
from collections import Counter
from urllib.parse import urlparse

import zstandard
from pyspark.sql import functions as F

from riskspark.llm import chat, warc
from riskspark.session import shared_folder

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[/TURN]", "[TEXT]", "[NEXT]", "[SYS]", "<\\s>", "<\\\\/s>", "[\\TURN]", "\\", "<", "[", "]"]


def test_escaping_round_trip(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(CONTROL + ["a", "\n", "é"], k=rng.randrange(12))) for _ in range(500)]
    shown = chat.escape(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", shown.alias("e"), chat.unescape(shown).alias("u")).collect()
    for r in rows:
        assert r.u == r.t
        assert not any(c in r.e for c in ("<s>", "</s>", "[TURN]", "[/TURN]", "[TEXT]", "[NEXT]", "[INST]", "[/INST]"))
        if not any(c in r.t for c in ("s>", "T]", "N]", "S]")):
            assert r.e == r.t


def test_conversations_read_back(spark):
    rng = random.Random(9)
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice([None, "", "hello\n\n", "".join(rng.choices(CONTROL, k=4)), "</s>[INST] ok [/INST]"])
            rows.append((conv, rng.choice([turn, turn, 0, None]), rng.choice(["user", "assistant", "assistant", "sys[TEXT]\n", None, ""]), text, 1))
    rows += rows[:6]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, Formatted int").repartition(4)
    made = chat.format_conversations(df)
    read = made.select("conv_id", "formatted", "loss_runs", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_runs")).alias("loss")).collect()
    by = {}
    for conv, turn, role, text, _ in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    assert len(read) == len(by)
    for r in read:
        want = sorted(by[r.conv_id])
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in want]
        assert r.loss == [text for _, role, text in want if role == "assistant"]
        assert sum(x.chars for x in r.loss_runs) == len(r.formatted)
        at, under = 0, []
        for x in r.loss_runs:
            if x.in_loss:
                under.append(r.formatted[at : at + x.chars])
            at += x.chars
        assert len(under) == len(r.loss)
        blocks = sum(1 for i, x in enumerate(want) if not i or want[i - 1][1] != x[1])
        assert r.formatted.count("[TURN]") == blocks  # adjacent turns of one role are one block
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_archives_round_trip(spark):
    rng = random.Random(8)
    html = [None, "", "<p>é</p>", "x" * 3_000_000, "\r\n\r\nWARC/1.1\r\n", *[rng.choice("abc") * rng.randrange(1, 4) for _ in range(60)]]
    rows = [(i, rng.choice([None, f"http://a/{i}", "http://b/\r\nX: y"]), h, 0) for i, h in enumerate(html)]
    rows += rows[3:7] + [(None, "http://n", "only null", 0), (None, "u", "a", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, Payload int").repartition(5)
    folder = f"file://{shared_folder(spark, 'warc-test')}"
    manifest = warc.write_archives(warc.plan_records(pages), folder, bundle_bytes=2_000_000)
    found = warc.read_archives(spark, folder, manifest).collect()
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)

    def want(i, h):
        refers = first.get(h or "", i)
        return (i, len((h or "").encode()), warc.payload_digest((h or "").encode()), "response" if refers == i else "revisit", None if refers == i else refers)

    got = Counter((r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in found)
    assert got == Counter(want(i, h) for i, _, h, _ in rows)
    assert manifest.count() == len(rows)
    for r in manifest.collect():  # one record by its frame alone
        record = warc.fetch_record(folder, r.asDict())
        assert next(warc.read_records(record))["record_id"] == r.record_id
    path = urlparse(f"{folder}/{manifest.first().bundle}").path
    data = open(path, "rb").read()
    sizes = warc.read_seek_table(data)
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).readall() for _ in range(1))
    assert len(whole) == sum(n for _, n in sizes)
    assert warc.archive(pages.limit(0)).collect() == []


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.archive(pages, least=5).collect()}
    assert kinds == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_any_text_is_an_id(spark):
    """Ids that look like none, or hold line ends, marks and percent signs, come back as they are, also as what is revisited."""
    ids = [None, "null", "", "a>b", "x\r\nWARC-Type: revisit", "%41", "é 漢", "urn:page:"]
    rows = [(i, "u", html) for i in ids for html in ("same", f"own {i!r}")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    folder = f"file://{shared_folder(spark, 'warc-ids')}"
    manifest = warc.write_archives(warc.plan_records(pages), folder)
    found = warc.read_archives(spark, folder, manifest).collect()
    assert Counter(r.page_id for r in found) == Counter({i: 2 for i in ids})
    assert {r.page_id for r in found if r.refers_to is None and r.payload_bytes == 4} == {""}
    assert {r.refers_to for r in found if r.record_type == "revisit"} == {""}
    names = [warc.record_id(i) for i in ids]
    assert len(set(names)) == len(ids) and [warc.page_of(n) for n in names] == ids
