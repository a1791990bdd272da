import hashlib
import random
import time

from granary.llm import warc


def rec(i, payload, refers=None):
    return warc.record(i, f"http://x/{i}", payload, refers, "2024-01-01T00:00:00Z")


def kinds(data):
    return [(k, h.get("x-page-id") if h else None, p) for k, _, _, h, p, _ in warc.salvage(data)]


def test_members_read_back():
    parts = [warc.member(rec(i, bytes([65 + i]) * i * 50)) for i in range(6)]
    assert kinds(b"".join(parts)) == [("record", str(i), bytes([65 + i]) * i * 50) for i in range(6)]
    assert kinds(parts[0] + warc.EMPTY + parts[1] + warc.EMPTY) == kinds(parts[0] + parts[1]) and warc.EMPTY[-1] == 0


def test_damage_inside_a_member():
    """Records before and after a damaged one of the same member are kept."""
    rng = random.Random(5)
    whole = [rec(i, rng.randbytes(200)) for i in range(50)]
    last = whole[-1].replace(b"HTTP/1.1 200 OK", b"HTTP/1.1 200 KO").replace(whole[-1][-40:-20], b"?" * 20)
    got = kinds(warc.member(b"".join([*whole[:-1], last])))
    assert [i for k, i, _ in got if k == "record"] == [str(i) for i in range(49)] and got[-1][0] == "gap"
    middle = whole[20].replace(whole[20][-60:-30], b"!" * 30)
    got = list(warc.salvage(warc.member(b"".join([*whole[:20], middle, *whole[21:]]))))
    assert [h["x-page-id"] for k, _, _, h, _, _ in got if k == "record"] == [str(i) for i in range(50) if i != 20]
    begin = sum(map(len, whole[:20]))
    assert [inner for k, _, _, _, _, inner in got if k == "gap"] == [(begin, begin + len(middle))]


def test_a_cut_member():
    """What a member that is cut short still holds is kept, and what follows is found."""
    rng = random.Random(6)
    whole = [rec(i, rng.randbytes(300)) for i in range(30)]
    data = warc.member(b"".join(whole))
    got = kinds(data[:-40])
    assert [i for k, i, _ in got if k == "record"] == [str(i) for i in range(29)] and [k for k, _, _ in got].count("gap") == 1
    got = kinds(data[: len(data) // 2] + warc.member(rec(77, b"x" * 120)))
    found = [i for k, i, _ in got if k == "record"]
    assert found[-1] == "77" and 10 < len(found) < 20 and found[:-1] == [str(i) for i in range(len(found) - 1)]


def test_false_marks_take_linear_time():
    rng = random.Random(7)
    for mark in (warc.MAGIC, b"WARC/1.1\r\nA: b\r\n"):
        took = []
        for n in (20_000, 80_000):
            data = b"".join(mark + rng.randbytes(5) for _ in range(n)) + rec(1, b"z" * 100)
            start = time.process_time()
            assert [k for k, _, _ in kinds(data)] == ["gap", "record"]
            took.append(time.process_time() - start)
        assert took[1] < 10 * took[0] + 0.5


def test_salvage_of_damaged_archives():
    rng = random.Random(4)
    parts = [warc.member(rec(i, rng.randbytes(400))) for i in range(5)]
    broken = bytearray(parts[2])
    broken[200] ^= 0xFF
    data = b"junk" + parts[0] + parts[1] + bytes(broken) + parts[3] + parts[4][:150]
    got = kinds(data)
    assert [k for k, _, _ in got] == ["gap", "record", "record", "gap", "record", "gap"]
    assert [i for k, i, _ in got if k == "record"] == ["0", "1", "3"]
    spans = [(a, b) for _, a, b, _, _, _ in warc.salvage(data)]
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_plain_records_and_wrong_digest():
    a, b, c = rec(1, b"a" * 120), rec(2, b"b" * 120), rec(3, b"c" * 120)
    assert [i for _, i, _ in kinds(a + b + c)] == ["1", "2", "3"]
    bad = b.replace(b"bbbb", b"bxbb", 1)
    assert [(k, i) for k, i, _ in kinds(a + bad + c)] == [("record", "1"), ("gap", None), ("record", "3")]
    assert kinds(b"") == []


def test_pages_round_trip(spark, tmp_path):
    same = "same page " * 30
    rows = [(1, "http://a\r\nX: y", same), (2, None, same), (3, "u", None), (4, "u", ""), (5, "u", "tiny"), (6, "u", "tiny"), (7, "u", "WARC/1.1\r\n\r\n" * 30), (2, None, same), (None, "u", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "'x' as payload")
    warc.write_warc(pages, f"file://{tmp_path}/w", bytes_per_file=900)
    got = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert {r.kind for r in got} == {"record"} and len(got) == len(rows)
    files = [f.read_bytes() for f in (tmp_path / "w").glob("part-*")]
    assert len(files) > 1
    ids = [h["warc-record-id"] for f in files for _, _, _, h, _, _ in warc.salvage(f)]
    assert len(set(ids)) == len(rows)
    for r in got:
        html = (next(h for i, _, h in rows if i == r.page_id) or "").encode()
        refers = 1 if html == same.encode() and r.page_id == 2 else None
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(html), hashlib.sha256(html).hexdigest(), refers)
        assert r.record_type == ("revisit" if refers else "response")
        assert refers or r.payload == html


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    assert warc.read_warc(spark, f"file://{tmp_path}/w").count() == 0
