import itertools
import random

from loopsight import catalogue
from loopsight.operators.assignment import assign
from loopsight.streaming.frames import new_frames
from conftest import TINY


def test_assignment_is_best():
    random.seed(3)
    for _ in range(200):
        pairs = [(a, b, random.random()) for a in range(4) for b in range(4) if random.random() < 0.5]
        sets = (c for n in range(5) for c in itertools.combinations(pairs, n))
        valid = [c for c in sets if len({a for a, _, _ in c}) == len({b for _, b, _ in c}) == len(c)]
        most, gain = max((len(c), sum(g for *_, g in c)) for c in valid)
        got = assign(pairs)
        assert len(got) == most and abs(sum(g for *_, g in got) - gain) < 1e-9


def test_optimal_matches_are_one_to_one(spark):
    rows = catalogue.QUERIES["match_optimal"](spark, TINY).collect()
    assert rows and len({(r["frame_index"], r["label"]) for r in rows}) == len({(r["frame_index"], r["truth_id"]) for r in rows}) == len(rows)


def test_frames_are_seen_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    for names in (["b2_10.png", "b2_9.png"], ["b2_11.png", "note.txt"]):
        for n in names:
            (folder / n).write_bytes(n.encode())
        query = (
            new_frames(spark, str(folder)).writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c"))
            .foreachBatch(lambda df, _: seen.append(sorted(r["frame_index"] for r in df.collect()))).start()
        )
        query.awaitTermination()
    assert seen == [[9, 10], [11]]
