from twinframe.llm import perspectives as p

SCHEMA = "conv_id long, turn long, role string, text string, name string, start long"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


ROWS = [
    (1, 0, "system", "Be brief"), (1, 1, "ann", "Hi é"), (1, 2, "bob", "Hello"), (1, 3, "ann", None), (1, 4, None, "noise"),
    (2, 0, "system", "alone"), (3, 0, "ann", "x" * 20_000), (None, 0, "bob", "lost"), (1, 1, "ann", "Hi é"), (3, None, "bob", "first"),
] + [(4, t, f"s{t % 3}", f"line {t}") for t in range(-3, 700)]


def brute(rows):
    views = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        for who in {r[2] for r in turns} - {None, "system"}:
            text, mask = "", []
            for _, _, role, said in turns:
                shown = "assistant" if role == who else "system" if role == "system" else "user"
                name = f" name={role}" if shown == "user" and role is not None else ""
                text += f"<|im_start|>{shown}{name}\n"
                if role == who:
                    mask.append((len(text), len(text) + len(said or "")))
                text += (said or "") + "<|im_end|>\n"
            views[c, who] = len(turns), text, mask
    return views


def test_views_equal_brute_force(spark):
    got = {(r.conv_id, r.perspective): (r.n_turns, r.text, [tuple(m) for m in r["mask"]]) for r in p.perspective_views(talk(spark, ROWS)).collect()}
    assert got == brute(ROWS)


def test_masks_hold_what_the_speaker_said(spark):
    for r in p.perspective_views(talk(spark, ROWS)).collect():
        said = sorted(t or "" for c, _, who, t in ROWS if c == r.conv_id and who == r.perspective)
        assert sorted(r.text[s:e] for s, e in r["mask"]) == said


def test_empty(spark):
    assert p.perspective_turns(talk(spark, ROWS).limit(0)).collect() == []
