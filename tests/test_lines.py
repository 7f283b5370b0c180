"""Lines of text by built-in functions against those made one by one."""

import random

from wavelake import report

MOST = 2**63 - 1


def test_annotation_lines(spark, tmp_path):
    r = random.Random(1)
    ticks = [0, 1, 9_999, 10_000, -1, -10_000, 36_000_000_000 * 27, MOST, -MOST] + [r.randrange(-(2**45), 2**45) for _ in range(40)]
    rows = [(k, t, r.choice([None, 0, 5, 10**7, 25_000_000, 12_345_678, MOST, r.randrange(2**50)]), r.choice(["", "plain", "tab\there", "é\x7f"]), r.choice([None, "", "Fp1", "a\nb"])) for k, t in enumerate(ticks)]
    df = spark.createDataFrame(rows, "k int, onset_ticks_from_first_record bigint, duration_ticks bigint, text string, channel_label string")
    for x in report.annotation_lines(df).collect():
        assert x.line == report.format_annotations([x.asDict()])
    report.write_annotations(df.orderBy("k"), str(tmp_path / "lines"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "lines")).collect()) == sorted(x.line for x in report.annotation_lines(df).collect())
