"""A text with its regions made visible, for terminals and for pages."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator, Mapping, Sequence

COLOURS = {"metadata": 35, "chapter.title": 33, "chapter.part": 33, "chapter.paragraph": 36, "chapter.sentence": 34, "quote.quote": 31, "quote.nonquote": 32, "quote.suspension": 36, "quote.embedded": 35}


def pieces(text: str, regions: Mapping[str, Sequence[tuple]]) -> Iterator[tuple[str, tuple[str, ...]]]:
    """The text between boundaries of regions, with the sorted classes that cover it."""
    turns: dict[int, list[tuple[int, str]]] = {0: [], len(text): []}
    for name, ranges in regions.items():
        for r in ranges:
            if r[0] < r[1]:
                turns.setdefault(r[0], []).append((1, name))
                turns.setdefault(r[1], []).append((-1, name))
    on: dict[str, int] = {}
    at = sorted(turns)
    for a, z in zip(at, at[1:], strict=False):
        for d, name in turns[a]:
            on[name] = on.get(name, 0) + d
        yield text[a:z], tuple(sorted(n for n, k in on.items() if k > 0))


def rendered(text: str, regions: Mapping[str, Sequence[tuple]], shown: Sequence[str] | None, wrap: Callable[[str, tuple[str, ...]], str]) -> str:
    chosen = {k: v for k, v in regions.items() if shown is None or any(k.startswith(s) for s in shown)}
    return "".join(wrap(t, on) if on else wrap(t, ()) for t, on in pieces(text, chosen))


def ansi(text: str, regions: Mapping[str, Sequence[tuple]], shown: Sequence[str] | None = None) -> str:
    """The text in colours for a terminal."""

    def wrap(t: str, on: tuple[str, ...]) -> str:
        code = next((c for n in reversed(on) for k, c in COLOURS.items() if n.startswith(k)), 7)
        return f"\x1b[{code}m{t}\x1b[0m" if on else t

    return rendered(text, regions, shown, wrap)


def spans(text: str, regions: Mapping[str, Sequence[tuple]], shown: Sequence[str] | None = None) -> str:
    """The text as HTML, a span with the classes around each stretch."""
    return rendered(text, regions, shown, lambda t, on: f'<span class="{" ".join(n.replace(".", "-") for n in on)}">{html.escape(t)}</span>' if on else html.escape(t))
