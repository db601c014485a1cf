"""Run settings as one typed record; values given, also by a YAML file, replace the defaults."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class RunConfig:
    objects: tuple[str, ...] = ()
    known_objects: tuple[str, ...] = ()
    shots: tuple[int, ...] = (1, 2, 4, 8)
    neighbours: int = 3
    tail_share: float = 0.01
    segmentation: str = "percentile"
    integration_limit: float = 0.3
    masking: dict[str, bool] = field(default_factory=dict)
    rotation: dict[str, bool] = field(default_factory=dict)
    test_mode: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.integration_limit <= 1:
            raise ValueError("the integration limit must be above 0 and at most 1")
        if self.segmentation not in ("percentile", "gmm"):
            raise ValueError(f"unknown segmentation: {self.segmentation}")
        unknown = set(self.objects) - set(self.known_objects)
        if self.known_objects and unknown:
            raise ValueError(f"unknown objects: {sorted(unknown)}")

    def with_values(self, values: dict) -> RunConfig:
        names = {f.name for f in fields(self)}
        if set(values) - names:
            raise ValueError(f"unknown settings: {sorted(set(values) - names)}")
        return replace(self, **values)

    def with_file(self, path: str) -> RunConfig:
        with open(path, encoding="utf-8") as f:
            values = read_settings(f.read())
        return self.with_values({k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def _without_comment(line: str) -> str:
    """A line up to a # outside of quotes that begins it or follows a space; an apostrophe inside a word opens no quotes."""
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (k == 0 or line[k - 1] in " [,:"):
            quote = c
        elif c == "#" and (k == 0 or line[k - 1].isspace()):
            return line[:k].rstrip()
    return line.rstrip()


def _listed(text: str, number: int) -> list:
    """The scalars of a list in brackets; commas inside quotes stay."""
    if not text.endswith("]"):
        raise ValueError(f"line {number}: a list must end on its line")
    parts, at, quote = [], 1, ""
    for k, c in enumerate(text[1:-1], 1):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and not text[at:k].strip():
            quote = c
        elif c in "[]{}":
            raise ValueError(f"line {number}: lists inside of lists are not read")
        elif c == ",":
            parts.append(text[at:k])
            at = k + 1
    return [_scalar(x) for x in [*parts, text[at:-1]] if x.strip()]


def _value(text: str, number: int):
    text = text.strip()
    if text.startswith("["):
        return _listed(text, number)
    if text[:1] in ("{", "&", "*", "!", "|", ">", "%", "@", "`"):
        raise ValueError(f"line {number}: {text[:1]} is a part of YAML that is not read; quote it if it is text")
    if text[:1] in ("'", '"') and (len(text) < 2 or text[-1] != text[0]):
        raise ValueError(f"line {number}: quotes that do not close")
    return _scalar(text)


def read_settings(text: str) -> dict:
    """The part of YAML that settings use: nested maps by indentation, lists of scalars, quoted or bare scalars, comments.

    Whatever else YAML has (maps in braces, maps or lists in lists, anchors, tags, blocks of text, tabs for indentation, keys that
    come twice) is an error that names the line, and never read as something else.
    """
    root: dict = {}
    open_maps: list[tuple[int, dict]] = [(-1, root)]
    last: tuple[dict, str] | None = None
    for number, line in enumerate(text.splitlines(), 1):
        bare = _without_comment(line)
        if not bare or bare == "---":
            continue
        if "\t" in bare[: len(bare) - len(bare.lstrip())]:
            raise ValueError(f"line {number}: tabs are no indentation")
        indent, item = len(bare) - len(bare.lstrip()), bare.strip()
        if item == "-" or item.startswith("- "):
            if last is None or last[0][last[1]] not in ({}, None) and not isinstance(last[0][last[1]], list):
                raise ValueError(f"line {number}: a list without a name")
            owner, key = last
            if not isinstance(owner[key], list):
                owner[key] = []
            if re.match(r"[^\"'\[]+:(\s|$)", item[2:]) or item[2:].lstrip().startswith(("- ", "[")):
                raise ValueError(f"line {number}: maps and lists in lists are not read")
            owner[key].append(_value(item[2:], number))
            continue
        found = re.fullmatch(r"""("[^"]*"|'[^']*'|[^:"']+(?::[^:\s]+)*)\s*:(?:\s+(.*))?""", item)
        if not found:
            raise ValueError(f"line {number} is no setting: {line!r}")
        while indent <= open_maps[-1][0]:
            open_maps.pop()
        owner, key = open_maps[-1][1], str(_scalar(found[1].strip()))
        if not isinstance(owner, dict) or key in owner:
            raise ValueError(f"line {number}: {key} comes twice")
        if found[2]:
            owner[key] = _value(found[2], number)
        else:
            owner[key] = {}
            open_maps.append((indent, owner[key]))
        last = (owner, key)
    return root


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() in ("null", "~", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text
