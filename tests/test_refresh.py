import pytest

from cutline.plans.registry import LEGACY, MODERN
from cutline.streaming.refresh import failed_pages, refresh


def _fact(spark, path):
    return sorted(tuple(map(str, r)) for r in spark.read.parquet(path).select("publication_date", "visa_class", "country", "cutoff_value").collect())


def test_refresh(spark, tmp_path):
    folder, fact = tmp_path / "pages", str(tmp_path / "fact")
    folder.mkdir()
    march = folder / "visa-bulletin-for-march-2023.html"
    march.write_text(MODERN)
    (folder / "about.html").write_text(MODERN)
    refresh(spark, str(folder), fact, str(tmp_path / "a"))
    first = _fact(spark, fact)
    assert ("2023-03-01", "F1", "china", "C") in first and {r[0] for r in first} == {"2023-03-01"}

    # nothing new; then a replay under a new checkpoint
    refresh(spark, str(folder), fact, str(tmp_path / "a"))
    refresh(spark, str(folder), fact, str(tmp_path / "b"))
    assert _fact(spark, fact) == first

    # one more month leaves the others alone; a corrected page counts only where all are read
    (folder / "visa-bulletin-for-March-2003.html").write_text(LEGACY)
    march.write_text(MODERN.replace("<td>C</td>", "<td>01JAN20</td>"))
    refresh(spark, str(folder), fact, str(tmp_path / "c"), mode="incremental")
    second = _fact(spark, fact)
    assert set(first) < set(second) and {r[0] for r in second} == {"2003-03-01", "2023-03-01"}
    refresh(spark, str(folder), fact, str(tmp_path / "d"), log=str(tmp_path / "log"))
    assert sorted((r["tables"], r["rows"], r["error"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [(1, 1, None), (1, 2, None)]
    third = _fact(spark, fact)
    assert len(third) == len(second) and ("2023-03-01", "F1", "china", "2020-01-01") in third and ("2023-03-01", "F1", "china", "C") not in third


def test_refresh_of_no_pages(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    refresh(spark, str(tmp_path / "pages"), str(tmp_path / "fact"), str(tmp_path / "c"))
    with pytest.raises(ValueError):
        refresh(spark, str(tmp_path / "pages"), str(tmp_path / "fact"), str(tmp_path / "c"), mode="other")


def test_failed_pages_are_tried_again(spark, tmp_path):
    """A page fails until a marker exists; it is tried three times in a refresh, and again in the next one, after which its cells are there."""
    folder, fact, log, marker, calls = tmp_path / "pages", str(tmp_path / "fact"), str(tmp_path / "log"), tmp_path / "well", tmp_path / "calls"
    folder.mkdir()
    calls.mkdir()
    (folder / "visa-bulletin-for-march-2023.html").write_text(MODERN)
    (folder / "visa-bulletin-for-March-2003.html").write_text(LEGACY)
    well, called = str(marker), str(calls)

    def parse(html):
        import os
        import uuid

        from cutline.sources import pages

        if "1<sup>" in html:
            open(f"{called}/{uuid.uuid4().hex}", "w").close()
            if not os.path.exists(well):
                raise ValueError("not now")
        return pages.page_tables(html)

    given = {"log": log, "delay": 0.01, "parse": parse}
    refresh(spark, str(folder), fact, str(tmp_path / "c"), **given)
    assert {r[0] for r in _fact(spark, fact)} == {"2023-03-01"} and len(list(calls.iterdir())) == 3
    assert [r["url"] for r in failed_pages(spark, log).collect()] == ["visa-bulletin-for-March-2003.html"]
    marker.write_text("")
    refresh(spark, str(folder), fact, str(tmp_path / "c"), **given)
    assert {r[0] for r in _fact(spark, fact)} == {"2003-03-01", "2023-03-01"} and failed_pages(spark, log).isEmpty()
    before = len(list(calls.iterdir()))
    refresh(spark, str(folder), fact, str(tmp_path / "c"), **given)
    assert len(list(calls.iterdir())) == before
