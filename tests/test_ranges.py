"""Files cut into byte ranges give what one reader of the whole file gives."""

import json
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from slidegrid.sources import ranges, readers


def of_bytes(content):
    return lambda at, n: content[at : at + n]


def plain(content):
    """(place in bytes, text, broken) by one pass over the decoded text."""
    text = content.decode()
    found, broken = readers.split_objects(text)
    return sorted((len(text[:p].encode()), t, b) for b, rows in ((False, found), (True, broken)) for p, t in rows)


def in_pieces(content, piece, look):
    """Each range from the exit of the one before, as the fixed point has it."""
    out, at = [], 0
    for end in range(piece, len(content) + piece, piece):
        if at < end:
            for begin, stop, broken in ranges.values_between(of_bytes(content), len(content), at, min(end, len(content)), look):
                if stop > begin:
                    out.append((begin, content[begin:stop].decode(), broken))
            at = begin
    return out


PARTS = st.sampled_from(['{"a": 1}', '{"b":{"c":[1,2.5e3,"}{"]}}', '{"d":,}', "[3, 4]", "17", " \n", '{"ä": "é}\\n{"}', '{"open": "', "}", "{", "true ", '"x{" ', "no", "﻿"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=12), st.integers(1, 40), st.integers(4, 40))
def test_any_cut_gives_the_same_values(parts, piece, look):
    content = "".join(parts).encode()
    assert in_pieces(content, piece, look) == plain(content)


def test_json_files_over_many_ranges(spark, tmp_path):
    rng = random.Random(5)
    for name in ("a", "b c", "empty"):
        rows = [json.dumps({"k": f"{name}{i}", "v": rng.choice(["x", "}{", "é" * rng.randrange(90), "y" * 700])}, ensure_ascii=False) for i in range(120)]
        rows[7] = '{"k": "cut", "v": '
        rows[50] = "junk " * 120
        (tmp_path / f"{name}.json").write_text("" if name == "empty" else rng.choice(["", "\n", " \r\n "]).join(rows))
    want = sorted(r for f in tmp_path.iterdir() for r in plain(f.read_bytes()))
    for piece, look in ((509, 64), (1 << 20, 1 << 16)):
        got = ranges.json_values(spark, str(tmp_path), piece, look).collect()
        assert sorted((r["place"], r["json"], r["broken"]) for r in got) == want
    parted = [r for r in ranges.json_values(spark, str(tmp_path), 509, 64, part=100).collect() if r["broken"]]
    assert max(len(r["json"].encode()) for r in parted) in range(97, 101)
    for name in ("a", "b c"):
        rest = sorted((r["place"], r["json"]) for r in parted if r["path"].endswith(f"/{name}.json"))
        assert "".join(t for _, t in rest) == "".join(t for _, t, b in plain((tmp_path / f"{name}.json").read_bytes()) if b)


def test_a_folder_without_values(spark, tmp_path):
    (tmp_path / "none.json").write_text("")
    assert ranges.json_values(spark, str(tmp_path)).count() == 0 and ranges.npy_features(spark, str(tmp_path)).count() == 0


def test_npy_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(3)
    wide = rng.integers(0, 1000, (500, 7)).astype("<f4")
    (tmp_path / "s1").mkdir()
    np.save(tmp_path / "s1" / "features.npy", wide)
    np.save(tmp_path / "columns.npy", np.asfortranarray(wide))
    np.save(tmp_path / "other order.npy", wide.astype(">f8"))
    np.save(tmp_path / "nothing.npy", wide[:0])
    np.save(tmp_path / "flat.npy", wide[0])
    np.save(tmp_path / "words.npy", np.array([["a", "b", "c"]]))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "columns.npy").read_bytes()[:-3])
    (tmp_path / "junk.npy").write_bytes(b"junk")
    for piece in (500, 1 << 20):
        got = ranges.npy_features(spark, str(tmp_path), piece=piece).collect()
        for slide in ("s1", "columns", "other order"):
            rows = sorted((r["tile_idx"], r["level"], r["x"], r["y"], *r["emb"]) for r in got if r["slide"] == slide)
            assert rows == [(i, *r) for i, r in enumerate(wide.tolist())]
        assert len(got) == 1500
    bad = {r["path"].split("/")[-1] for r in readers.npy_quarantine(spark, str(tmp_path)).collect()}
    assert bad == {"flat.npy", "words.npy", "cut.npy", "junk.npy"}
