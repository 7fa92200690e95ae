"""Every defect is absent from the clean feed and found in the damaged one."""

from tidemark.sources.pathologies import CATALOGUE, TEXTS, pathology_report


def test_defects_are_found_and_not_imagined(spark):
    rows = {r["defect"]: (r["clean"], r["damaged"]) for r in pathology_report(spark, "/root/testdata/sf0.01").collect()}
    assert set(rows) == {*CATALOGUE, *TEXTS}
    for name, (clean, damaged) in rows.items():
        assert clean == 0 and damaged > 0, (name, clean, damaged)
    assert rows["missing_days"][1] == 3 and rows["bulk_order"][1] == 1 and rows["renamed_column"][1] == 2
