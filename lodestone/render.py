"""Text for people, from collected rows."""

from __future__ import annotations

from collections.abc import Iterable


def edge_lines(edges: Iterable[tuple[str, str]]) -> str:
    """Links by source, sorted, as a list of arrows."""
    by = format_adjacency(edges)
    return "\n".join(line for a, targets in by.items() for line in (a, *[f"  └─> {b}" for b in targets])) or "(no links)"


def format_edges(pairs: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Distinct links, sorted."""
    return sorted(set(pairs))


def format_adjacency(pairs: Iterable[tuple[str, str]], reverse: bool = False) -> dict[str, list[str]]:
    """Each symbol with those it leads to, sorted; reversed, with those that lead to it."""
    by: dict[str, set[str]] = {}
    for a, b in pairs:
        by.setdefault(b if reverse else a, set()).add(a if reverse else b)
    return {k: sorted(v) for k, v in sorted(by.items())}


def tree_text(nodes: Iterable[tuple[str, str, bool, int]]) -> str:
    """nodes: parent folder, name, whether it is a file, symbols; as a tree by name."""
    children: dict[str, list[tuple[str, bool, int]]] = {}
    for parent, name, is_file, symbols in nodes:
        children.setdefault(parent, []).append((name, is_file, symbols))
    out: list[str] = []

    def draw(parent: str, before: str) -> None:
        own = sorted(children.get(parent, ()))
        for k, (name, is_file, symbols) in enumerate(own):
            last = k == len(own) - 1
            out.append(f"{before}{'└── ' if last else '├── '}{name}" + (f" ({symbols} symbols)" if is_file else "/"))
            if not is_file:
                draw(f"{parent}/{name}" if parent else name, before + ("    " if last else "│   "))

    draw("", "")
    return "\n".join(out)


def listed(head: str, pairs: Iterable[tuple[str, object]]) -> str:
    """A heading and aligned ``name: value`` lines; pairs without a value are left out."""
    pairs = [(k, v) for k, v in pairs if v not in (None, "")]
    width = max((len(k) for k, _ in pairs), default=0) + 1
    return "\n".join([head, *[f"{k + ':':<{width}} {v}" for k, v in pairs]])


def section(head: str, rows: Iterable[str], shown: int | None = None) -> str:
    """A heading with the number of rows, and the first of them; nothing where there are none."""
    rows = list(rows)
    if not rows:
        return ""
    more = [f"  and {len(rows) - shown} more"] if shown is not None and len(rows) > shown else []
    return "\n".join([f"\n{head} ({len(rows)})", *[f"  {r}" for r in rows[:shown]], *more])
