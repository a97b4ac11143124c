"""python -m quillon dataset [--target y] ...: analyse a file and write the report."""

from __future__ import annotations

import sys

from .config import CHOICES, describe, from_args
from .errors import QuillonError


#: What the interactive entry asks, in order.
QUESTIONS = [
    ("target", "Target column (empty: chosen automatically)"), ("delimiter", "Delimiter"), ("exclude", "Columns to leave out, by comma"), ("profile", "Profile"), ("outlier_method", "Outlier rule"),
    ("outlier_action", "What to do with outliers"), ("scaling", "Scaling"), ("feature_strategy", "Feature strategy"), ("neural_strategy", "Neural strategy"), ("report", "Report file"),
]


def asked(argv: list[str], ask=input, say=print) -> list[str]:
    """Arguments from answers; an empty answer keeps the default, a wrong one is asked again."""
    out = [a for a in argv if a != "--interactive"]
    defaults = {key: default for key, _, default in describe()}
    if not any(not a.startswith("--") for a in out):
        out.insert(0, ask("Dataset: ").strip())
    for key, text in QUESTIONS:
        allowed = sorted(CHOICES.get(key, ()))
        while True:
            answer = ask(f"{text}{f' {allowed}' if allowed else ''} [{defaults.get(key)}]: ").strip()
            if not answer or not allowed or answer in allowed:
                break
            say(f"{answer!r} is not one of {allowed}")
        if answer:
            out += [f"--{key.replace('_', '-')}", answer]
    return out


def main(argv: list[str]) -> int:
    if "--describe-params" in argv:
        for key, kind, default in describe():
            print(f"{key}\t{kind}\t{default}")
        return 0
    try:
        config = from_args(asked(argv) if "--interactive" in argv else argv)
        from .plans.analyze import analyze, write
        from .session import session

        result = analyze(config.dataset, config, session())
        print(write(result, config))
        return 0
    except QuillonError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
