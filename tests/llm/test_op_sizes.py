"""Operators whose results or work must not depend on how large their inputs are."""

from gatehouse.llm import html


def test_templates_of_all_hosts_are_not_limited_in_number(spark, monkeypatch):
    """The share that makes a template doesn't rise with the number of templates."""
    monkeypatch.setattr(html, "MOST_EVERYWHERE", 1, raising=False)
    page = "<body><div>shown everywhere</div><div>here as well</div><article><p>text {0}</p></article></body>"
    frame = spark.createDataFrame([(i, f"http://h{i}.org/a", page.format(i)) for i in range(20)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract_text(frame, landmarks=False).collect()}
    assert got == {i: f"text {i}" for i in range(20)}


def test_sorted_hashes_are_a_set():
    hashes = [5, -(1 << 63), (1 << 63) - 1, 0]
    known = html._Sorted(hashes)
    assert all(h in known for h in hashes) and not any(h in known for h in (1, -1, 6)) and 1 not in html._Sorted([])
