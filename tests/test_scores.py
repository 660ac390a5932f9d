"""Strict score files."""

import random

import pytest

from framelark.sources import scores as S

META = {"head": "activity", "outputs": 3, "midi_min": 40, "sample_rate": 22050, "hop_size": 256, "threshold": 7}
MAGIC = "SCORES_V1"


def text(frames=4, magic=True, change=None, **meta):
    head = META | {"frames": frames} | meta
    lines = ([f"#{MAGIC}"] if magic else []) + [f"#{k}={v}" for k, v in head.items() if v is not None]
    lines.append("\t".join(["frame", *(f"{c}_{p}" for c in ("score", "pred") for p in range(40, 43))]))
    lines += [f"{f}\t{f}\t-5\t7\t0\t1\t{f % 2}" for f in range(frames)]
    return "\n".join(change(lines) if change else lines) + "\n"


def test_round_trip_in_parts(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(f, p, s := rnd.randint(-(2**31), 2**31 - 1), int(s > 7)) for f in range(500) for p in range(40, 43)]
    table = spark.createDataFrame(rows, "frame long, pitch int, score int, pred int").repartition(6)
    path = str(tmp_path / "s")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        S.write_score_file(table, path, MAGIC, META | {"member_id": "m1"})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "s").glob("part-*"))) > 1
    meta, got = S.read_score_file(spark, path, MAGIC)
    assert meta["frames"] == 500 and meta["member_id"] == "m1" and got.exceptAll(table).count() == 0 and got.count() == 1500
    whole = "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*")))
    assert whole.startswith(f"#{MAGIC}\n#head=activity\n") and [int(x.split("\t")[0]) for x in whole.splitlines()[10:]] == list(range(500))


@pytest.mark.parametrize(
    ("content", "problem"),
    [
        (text(magic=False), "missing SCORES_V1"),
        (text(change=lambda x: [x[0], *x]), "duplicate SCORES_V1"),
        (text(change=lambda x: [*x[:2], "#threshold=8", *x[2:]]), "duplicate metadata key threshold"),
        (text(change=lambda x: [x[0], "#nonsense", *x[1:]]), "malformed metadata"),
        (text(hop_size=None), "missing metadata key hop_size"),
        (text(outputs="x"), "outputs is no whole number"),
        (text(midi_min=41), "unexpected columns"),
        (text(change=lambda x: [*x, "#late=1"]), "metadata after the columns"),
        (text(change=lambda x: [*x[:-1], ""]), "blank line"),
        (text(change=lambda x: [*x[:-1], x[-1] + "\t1"]), "another number of columns: 8"),
        (text(change=lambda x: [*x[:-1], x[-1].replace("-5", "5.0")]), "not a whole number"),
        (text(change=lambda x: [*x[:-1], x[-1].replace("-5", "3000000000")]), "score outside int32"),
        (text(change=lambda x: [*x[:-1], x[-1][:-1] + "2"]), "not 0 or 1"),
        (text(change=lambda x: [*x, x[-1]]), "frame occurs twice"),
        (text(change=lambda x: x[:-1]), "3 of 4 frames"),
        (text(change=lambda x: [*x, x[-1].replace("3", "4", 1)]), "frame out of range"),
        (text(0), "frames is not positive"),
    ],
)
def test_broken_files_are_refused(spark, tmp_path, content, problem):
    (tmp_path / "s.tsv").write_text(content)
    with pytest.raises(ValueError, match=problem):
        S.read_score_file(spark, str(tmp_path / "s.tsv"), MAGIC)
