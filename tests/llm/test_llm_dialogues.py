import random
from collections import Counter

from shelfline.llm import perspectives

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_dialogues_are_whole_and_masks_hold_in_them(llm):
    draw = random.Random(2)
    turns = [(c, t, draw.choice(["ann", "bob", "system"]), f"é{c} {t}") for c in (1, 2) for t in range(400)]
    turns += [(3, None, "ann", "none"), (3, 1, "bob", None), (3, 1, None, "tie"), (3, 1, "ann", "z"), (3, 1, "ann", "z")]
    turns += [(None, 0, "x", "lost\nline"), (None, 1, "y name=x", ""), (4, 0, "system", "alone")]
    draw.shuffle(turns)
    frame = llm.createDataFrame(turns, SCHEMA).repartition(5)
    found = perspectives.render_dialogues(frame).collect()
    want = {(t[0], t[2]) for t in turns} - {(c, "system") for c in (1, 2, 4)} - {(3, None)}
    assert Counter((r["conv_id"], r["perspective"]) for r in found) == Counter(want)
    spoken = {}
    for row in found:
        own = sorted((t for t in turns if t[0] == row["conv_id"]), key=lambda t: (t[1] is not None, t[1] or 0))
        masked = [row["rendered"][m["start"] : m["end"]] for m in row["masks"]]
        assert masked == [(t[3] or "") + "<|im_end|>" for t in own if t[2] == row["perspective"]]
        parts = row["rendered"].split("<|im_end|>\n")
        said = [p.split("\n", 1)[1] for p in parts[:-1]]
        assert Counter(said) == Counter(t[3] or "" for t in own)
        if row["conv_id"] != 3:
            assert said == [t[3] for t in own]
        # Ties come in the same order in every perspective.
        assert spoken.setdefault(row["conv_id"], said) == said
    assert perspectives.render_dialogues(frame.limit(0)).count() == 0


def test_places_and_starts_run_on_over_blocks(llm):
    turns = [(1, t, "ab"[t % 2], "w" * (t % 13)) for t in range(1000)]
    rows = perspectives.place_turns(perspectives.rotate(llm.createDataFrame(turns, SCHEMA))).collect()
    for who in "ab":
        own = sorted((r for r in rows if r["perspective"] == who), key=lambda r: r["turn"])
        at = 0
        for place, row in enumerate(own):
            assert (row["place"], row["start"]) == (place, at)
            at += len(row["rendered"])
