"""Output configuration: a subset of YAML (mappings by indent, scalars, comments) and dated output folders."""

from __future__ import annotations

import ast
import datetime
import re
from pathlib import Path

#: Folder of a day's outputs, unless date_folder_format says otherwise.
DATE_FORMAT = "%d_%m_%y"
#: Values of group_outputs_by_day, as text, that turn it off.
OFF = ("0", "false", "no", "off")

# A line up to its comment: quoted parts (a backslash takes the next character with it) or anything but a hash.
_CODE = re.compile(r"""(?:\\.|'(?:\\.|[^'\\])*(?:'|$)|"(?:\\.|[^"\\])*(?:"|$)|[^#'"\\]|\\$)*""")


def strip_comment(line: str) -> str:
    """The line up to the first # outside quotes."""
    return _CODE.match(line)[0].rstrip()


def parse_value(text: str) -> object:
    """null, true and false, quoted text, bracketed literals, numbers; anything else is text."""
    text = text.strip()
    constant = {"": None, "null": None, "none": None, "true": True, "false": False}
    if text.lower() in constant:
        return constant[text.lower()]
    if len(text) > 1 and text[0] in "'\"" and text[-1] in "'\"":
        return text[1:-1]
    if text[0] in "[{(":
        try:
            return ast.literal_eval(text)
        except (ValueError, SyntaxError):
            return text
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def load_config(path: str | Path) -> dict:
    """The file as nested dicts; lines without a colon say nothing, a missing file is an empty configuration."""
    path = Path(path)
    if not path.exists():
        return {}
    root: dict = {}
    #: What lines of at least this indent belong to, outermost first.
    levels = [(0, root)]
    for raw in path.read_text(encoding="utf-8").splitlines():
        line = strip_comment(raw)
        key, colon, value = (part.strip() for part in line.partition(":"))
        if not colon:
            continue
        indent = len(line) - len(line.lstrip())
        levels = [levels[0], *[level for level in levels[1:] if level[0] <= indent]]
        owner = levels[-1][1]
        if value:
            owner[key] = parse_value(value)
        else:
            owner[key] = {}
            levels.append((indent + 1, owner[key]))
    return root


def date_folder(day: datetime.date | None = None, date_format: str = DATE_FORMAT) -> str:
    return (day or datetime.date.today()).strftime(date_format)


def dated_root(root: str | Path, day: datetime.date | None = None, date_format: str = DATE_FORMAT) -> Path:
    """root/<day>, once: a root that ends in the day's folder is itself."""
    root, name = Path(root), date_folder(day, date_format)
    return root if root.name == name else root / name


def output_root(config: dict, project: str | Path = ".", default: str | Path = "outputs", day: datetime.date | None = None) -> Path:
    """Where outputs go: output_root (relative to the project) under the day's folder, unless group_outputs_by_day is off."""
    named = config.get("output_root")
    root = Path(project) / (default if named is None else str(named))
    grouped = config.get("group_outputs_by_day", True)
    if isinstance(grouped, str):
        grouped = grouped.strip().lower() not in OFF
    return dated_root(root, day, str(config.get("date_folder_format") or DATE_FORMAT)) if grouped else root
