"""The invisible-character rule: what is removed, what is kept and counted."""

from __future__ import annotations

import re

#: Characters without width, and spaces that stay on their line.
ZERO_WIDTH = "\u00ad\u034f\u061c\u180e\u200b-\u200f\u2060-\u2064\ufeff"
HORIZONTAL = "\t \u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: Ranges of code points with the Emoji property beyond ASCII.
EMOJI = (
    "\u00a9\u00ae\u203c\u2049\u2122\u2139\u2194-\u2199\u21a9-\u21aa\u231a-\u231b\u2328\u23cf\u23e9-\u23f3\u23f8-\u23fa\u24c2"
    "\u25aa-\u25ab\u25b6\u25c0\u25fb-\u25fe\u2600-\u2604\u260e\u2611\u2614-\u2615\u2618\u261d\u2620\u2622-\u2623\u2626\u262a"
    "\u262e-\u262f\u2638-\u263a\u2640\u2642\u2648-\u2653\u265f-\u2660\u2663\u2665-\u2666\u2668\u267b\u267e-\u267f\u2692-\u2697"
    "\u2699\u269b-\u269c\u26a0-\u26a1\u26a7\u26aa-\u26ab\u26b0-\u26b1\u26bd-\u26be\u26c4-\u26c5\u26c8\u26ce-\u26cf\u26d1"
    "\u26d3-\u26d4\u26e9-\u26ea\u26f0-\u26f5\u26f7-\u26fa\u26fd\u2702\u2705\u2708-\u270d\u270f\u2712\u2714\u2716\u271d\u2721"
    "\u2728\u2733-\u2734\u2744\u2747\u274c\u274e\u2753-\u2755\u2757\u2763-\u2764\u2795-\u2797\u27a1\u27b0\u27bf\u2934-\u2935"
    "\u2b05-\u2b07\u2b1b-\u2b1c\u2b50\u2b55\u3030\u303d\u3297\u3299\U0001f004\U0001f0cf\U0001f170-\U0001f171\U0001f17e-\U0001f17f"
    "\U0001f18e\U0001f191-\U0001f19a\U0001f1e6-\U0001f1ff\U0001f201-\U0001f202\U0001f21a\U0001f22f\U0001f232-\U0001f23a"
    "\U0001f250-\U0001f251\U0001f300-\U0001f321\U0001f324-\U0001f393\U0001f396-\U0001f397\U0001f399-\U0001f39b\U0001f39e-\U0001f3f0"
    "\U0001f3f3-\U0001f3f5\U0001f3f7-\U0001f4fd\U0001f4ff-\U0001f53d\U0001f549-\U0001f54e\U0001f550-\U0001f567\U0001f56f-\U0001f570"
    "\U0001f573-\U0001f57a\U0001f587\U0001f58a-\U0001f58d\U0001f590\U0001f595-\U0001f596\U0001f5a4-\U0001f5a5\U0001f5a8"
    "\U0001f5b1-\U0001f5b2\U0001f5bc\U0001f5c2-\U0001f5c4\U0001f5d1-\U0001f5d3\U0001f5dc-\U0001f5de\U0001f5e1\U0001f5e3\U0001f5e8"
    "\U0001f5ef\U0001f5f3\U0001f5fa-\U0001f64f\U0001f680-\U0001f6c5\U0001f6cb-\U0001f6d2\U0001f6d5-\U0001f6d7\U0001f6dc-\U0001f6e5"
    "\U0001f6e9\U0001f6eb-\U0001f6ec\U0001f6f0\U0001f6f3-\U0001f6fc\U0001f7e0-\U0001f7eb\U0001f7f0\U0001f90c-\U0001f93a"
    "\U0001f93c-\U0001f945\U0001f947-\U0001f9ff\U0001fa70-\U0001fa7c\U0001fa80-\U0001fa89\U0001fa8f-\U0001fac6\U0001face-\U0001fadc"
    "\U0001fadf-\U0001fae9\U0001faf0-\U0001faf8"
)
TONES = "\U0001f3fb-\U0001f3ff"
COUNTERS = ("zero_width_chains", "tag_characters", "zero_width_spaces", "byte_order_marks", "joiners", "direction_marks", "bidi_controls")

# a run of spaces alone is no match, so plain text costs no call
_RUN = re.compile(f"[{HORIZONTAL}]*[{ZERO_WIDTH}][{ZERO_WIDTH}{HORIZONTAL}]*")
_NO_WIDTH = re.compile(f"[{ZERO_WIDTH}]")
_SPACE = re.compile(f"[{HORIZONTAL}]")
_STRAY = re.compile("(\U0001f3f4[\U000e0020-\U000e007e]+\U000e007f)|(\u200b)|(\ufeff)|[\U000e0000-\U000e007f]")
# an emoji is matched again as the left side of the joiner behind it, so it stands in a lookahead
_JOINED = re.compile(f"(?:[{EMOJI}])[\ufe0f{TONES}]*(?=\u200d[{EMOJI}])")
_ALL_EMOJI = re.compile(f"[{EMOJI}{TONES}\ufe0f\u200d]*[{EMOJI}][{EMOJI}{TONES}\ufe0f\u200d]*")
_SUSPECT = re.compile(f"[{ZERO_WIDTH}\u202a-\u202e\u2066-\u2069\U000e0000-\U000e007f]")


def clean(text: str) -> tuple[str, dict[str, int]]:
    """The text as a reader sees it, and what was removed (the first four counters) or kept."""
    found = dict.fromkeys(COUNTERS, 0)
    if not _SUSPECT.search(text):
        return text, found
    text = text.replace("\u00a0\u200d\u200b", " ")  # a space of a code block

    def chain(m):
        n = len(_NO_WIDTH.findall(m[0]))
        if n < 3:
            return m[0]
        found["zero_width_chains"] += n
        inside = 0 < m.start() and m.end() < len(text) and text[m.start() - 1] != "\n" and text[m.end()] != "\n"
        return " " if inside and _SPACE.search(m[0]) else ""

    def stray(m):
        if m[1]:
            return m[1]
        found["zero_width_spaces" if m[2] else "byte_order_marks" if m[3] else "tag_characters"] += 1
        return ""

    text = _RUN.sub(chain, text)
    text = _STRAY.sub(stray, text)
    found["joiners"] = text.count("\u200d") - len(_JOINED.findall(text))
    found["direction_marks"] = text.count("\u200e") + text.count("\u200f")
    found["bidi_controls"] = len(re.findall("[\u202a-\u202e\u2066-\u2069]", text))
    return text, found


def is_emoji(text: str) -> bool:
    """Whether a text is nothing but emoji, joined, varied or toned."""
    return _ALL_EMOJI.fullmatch(text) is not None
