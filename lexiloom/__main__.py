"""Command line: ``python -m lexiloom <command> <arguments>``; ``--help`` lists commands, ``<command> --help`` its arguments."""

from __future__ import annotations

import argparse
import inspect

from . import drivers
from .session import session, ship

#: command -> (function, fixed arguments).
COMMANDS: dict = {
    "write-file-list": (drivers.file_list, {}),
    **{name: (drivers.edit, {"editor": name}) for name in drivers.EDITORS},
    "route-files": (drivers.route, {}),
    "extract-narratives": (drivers.narratives, {}),
    "build-reference-template": (drivers.reference_template, {}),
    "extract-stories": (drivers.stories, {}),
    "extract-training-pairs": (drivers.training_pairs, {}),
    "convert-stories": (drivers.stories_to_transcripts, {}),
    "build-score-table": (drivers.score_tables, {}),
    "clean-workbook": (drivers.clean_workbook, {}),
    "merge-scores": (drivers.merge_scores, {}),
    "build-error-codes": (drivers.error_codes, {}),
    "build-grouped-errors": (drivers.grouped_errors, {}),
    "build-past-verbs": (drivers.past_verbs, {}),
    "build-syntax": (drivers.syntax, {}),
    "replace-features": (drivers.replace_features, {}),
    "add-error-rates": (drivers.error_rates, {}),
    "build-severity-features": (drivers.severity_features, {}),
    "build-age-adjusted": (drivers.age_adjusted, {}),
    "build-severity-profile": (drivers.severity_profile, {}),
    "audit-redundancy": (drivers.redundancy, {}),
    "build-generated-measures": (drivers.generated_measures, {}),
    "build-generation-package": (drivers.generation_package, {}),
    "build-generation-packages": (drivers.generation_packages, {}),
    "build-frozen-roster": (drivers.frozen_roster, {}),
    "build-story-design": (drivers.story_design, {}),
    "build-loocv-plan": (drivers.loocv_plan, {}),
    "evaluate-bundles": (drivers.bundle_evaluation, {}),
    "evaluate-texts": (drivers.text_evaluation, {}),
    "evaluate-perplexity": (drivers.text_perplexity, {}),
    "evaluate-semantics": (drivers.text_semantics, {}),
    "choose-preferred": (drivers.preferred, {}),
    "count-tokens": (drivers.token_table, {}),
    "score-stories": (drivers.score_stories, {}),
    "show-counterbalance": (drivers.show, {}),
    "show-manifest": (drivers.show, {}),
    "validate-layout": (drivers.validate_layout, {}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexiloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    kinds = {"int": int, "float": float, "int | None": int}
    for name, (function, fixed) in COMMANDS.items():
        sub = commands.add_parser(name, help=(function.__doc__ or "").split("\n")[0])
        for p in list(inspect.signature(function).parameters.values())[1:]:
            if p.name in fixed:
                continue
            flag = p.name.strip("_").replace("_", "-")
            if p.default is p.empty:
                sub.add_argument(p.name, metavar=flag)
            elif p.annotation == "bool":
                sub.add_argument(f"--{flag}", dest=p.name, action="store_true")
            else:
                sub.add_argument(f"--{flag}", dest=p.name, type=kinds.get(p.annotation, str), default=p.default)
    return out


def main(argv: list[str] | None = None) -> None:
    args = vars(parser().parse_args(argv))
    function, fixed = COMMANDS[args.pop("command")]
    function(ship(session()), **fixed, **args)


if __name__ == "__main__":
    main()
