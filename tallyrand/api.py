"""Making worlds from recipes, saving and checking them.

    python -m tallyrand.api generate RECIPE FOLDER [--mode public] [--seed 42] [--set key=value ...]
    python -m tallyrand.api inspect FOLDER | validate FOLDER | list-recipes
    python -m tallyrand.api release GATES TIER:SEED=FOLDER ...
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from .generate import graph, leads, lifecycle
from .operators import pointintime, release, snapshots
from .sources import bundle
from .sources.tables import materialised

#: Recipes: a kind of world and what differs from its defaults. Later settings win: package, recipe, overrides.
RECIPES: dict[str, dict] = {
    "leads_intro": {"kind": "leads", "motif": "fit_dominant", "target_rate": (0.35, 0.50), "signal": 0.9},
    "leads_intermediate": {"kind": "leads", "motif": "sales_execution_sensitive", "target_rate": (0.18, 0.28), "signal": 0.7, "committee_friction": 0.5},
    "leads_advanced": {"kind": "leads", "motif": "buying_committee_friction", "target_rate": (0.06, 0.12), "signal": 0.5, "committee_friction": 1.0},
    "customers_growth": {"kind": "customers", "motif": "expansion_led_growth"},
    "customers_fragile": {"kind": "customers", "motif": "payment_fragile"},
}
#: How far each tier's snapshots are distorted, and the tier of each recipe. Fixed values.
DIFFICULTIES = {"intro": snapshots.Difficulty(0.10, 0.02, 0.01), "intermediate": snapshots.Difficulty(0.30, 0.08, 0.04), "advanced": snapshots.Difficulty(0.55, 0.18, 0.08)}
TIER = {"leads_intro": "intro", "leads_intermediate": "intermediate", "leads_advanced": "advanced", "customers_growth": "intermediate", "customers_fragile": "intermediate"}
# Which keys lead to which tables.
LEAD_KEYS = (("contacts", "account_id", "accounts", "account_id"), ("leads", "contact_id", "contacts", "contact_id"), ("leads", "account_id", "accounts", "account_id"), *((t, "lead_id", "leads", "lead_id") for t in ("touches", "sessions", "sales_activities", "opportunities")), ("customers", "opportunity_id", "opportunities", "opportunity_id"), ("subscriptions", "customer_id", "customers", "customer_id"))
CUSTOMER_KEYS = tuple((t, "customer_id", "customers", "customer_id") for t in ("subscriptions", "subscription_events", "health_signals", "invoices"))


def configured(recipe: str, overrides: Mapping | None = None):
    """The world of a recipe with overrides; unknown recipes and settings raise."""
    if recipe not in RECIPES:
        raise ValueError(f"no recipe {recipe!r}; there are {sorted(RECIPES)}")
    settings = dict(RECIPES[recipe])
    made = leads.LeadWorld if settings.pop("kind") == "leads" else lifecycle.LifecycleWorld
    settings |= overrides or {}
    if unknown := set(settings) - {f.name for f in fields(made)}:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return made(**settings)


@dataclass
class World:
    spark: SparkSession
    recipe: str
    config: leads.LeadWorld | lifecycle.LifecycleWorld
    tables: dict[str, DataFrame]
    tier: str = "intermediate"

    @property
    def is_leads(self) -> bool:
        return isinstance(self.config, leads.LeadWorld)

    def distorted(self, snapshot: DataFrame) -> DataFrame:
        features, key = (snapshots.LEAD_FEATURES, "lead_id") if self.is_leads else (snapshots.CUSTOMER_FEATURES, "customer_id")
        return snapshots.made_difficult(materialised(snapshot), features, key, DIFFICULTIES[self.tier], self.config.seed)

    def save(self, folder: str, *, mode: str = "public", window: int = 30, cutoff: str | None = None, files: int | None = None) -> dict:
        """Writes a bundle as ``mode`` may show it, its snapshots distorted as the world's tier asks; returns the manifest."""
        safe = bundle.MODES[mode].snapshot_safe
        if self.is_leads:
            shown = self.tables
            if safe:
                shown = pointintime.safe_tables(self.tables, window=window, times=bundle.TIMES, banned=bundle.BANNED, omitted=bundle.OMITTED)
            shots = {"conversion": self.distorted(snapshots.lead_snapshot(self.tables, window=window))}
            key, features = "lead_id", snapshots.LEAD_FEATURES
            hidden = {"graph.json": graph.sample(self.config.motif, self.config.seed).to_json(), "graph.graphml": graph.sample(self.config.motif, self.config.seed).to_graphml()}
        else:
            cutoff = cutoff or "2023-06-05"
            times = {"subscription_events": "event_timestamp", "health_signals": "period_start", "invoices": "invoice_date", "customers": "customer_start_at"}
            shown = {t: pointintime.until(df, times[t], cutoff) if safe and t in times else df for t, df in self.tables.items()}
            if safe:
                shown["subscriptions"] = pointintime.until(shown["subscriptions"], "subscription_start_at", cutoff).drop("subscription_status", "current_mrr", "renewal_count", "expansion_count", "subscription_end_at", "churn_at", "churn_reason")
                shown["subscription_events"] = shown["subscription_events"].drop("churn_reason")
            whole = self.distorted(snapshots.customer_snapshot(self.tables, cutoff=cutoff, weeks=self.config.weeks))
            targets = [f.name for f in snapshots.CUSTOMER_FEATURES if f.role == "target"]
            shots = {t: snapshots.single_target(whole, snapshots.CUSTOMER_FEATURES, t) for t in targets}
            key, features, hidden = "customer_id", snapshots.CUSTOMER_FEATURES, {}
        hidden["config.json"] = json.dumps(asdict(self.config), sort_keys=True)
        return bundle.write_bundle(self.spark, folder, name=self.recipe, tables=shown, snapshots=shots, key=key, features=features, mode=mode, config=asdict(self.config), hidden=hidden, extra={"recipe": self.recipe, "difficulty": self.tier, "kind": "leads" if self.is_leads else "customers"}, files=files)


def generate(spark: SparkSession, recipe: str, *, difficulty: str | None = None, **overrides) -> World:
    """A world of a recipe; difficulty: the tier of its snapshots, by default the recipe's."""
    config = configured(recipe, overrides)
    tier = difficulty or TIER[recipe]
    if tier not in DIFFICULTIES:
        raise ValueError(f"no difficulty {tier!r}; there are {sorted(DIFFICULTIES)}")
    tables = leads.simulate(spark, config) if isinstance(config, leads.LeadWorld) else lifecycle.simulate(spark, config)
    return World(spark, recipe, config, tables, tier)


def validate(spark: SparkSession, folder: str) -> list[str]:
    is_leads = bundle.read_json(spark, f"{folder}/manifest.json").get("kind") == "leads"
    return bundle.validate_bundle(spark, folder, keys=LEAD_KEYS, banned=bundle.BANNED, omitted=bundle.OMITTED) if is_leads else bundle.validate_bundle(spark, folder, keys=CUSTOMER_KEYS, banned={"subscriptions": ("churn_at", "current_mrr")}, omitted=())


def release_report(spark: SparkSession, bundles: Mapping[str, Mapping[int, str]], gates: release.Gates) -> tuple[DataFrame, DataFrame]:
    """The report on lead bundles (tier -> seed -> folder) and the gates that they fail."""
    target = next(f.name for f in snapshots.LEAD_FEATURES if f.role == "target")
    ids = [f.name for f in snapshots.LEAD_FEATURES if f.name.endswith("_id")]
    return release.judged(spark, bundles, gates, task="conversion", key="lead_id", label=target, time="lead_created_at", without=ids)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tallyrand")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate")
    g.add_argument("recipe")
    g.add_argument("folder")
    g.add_argument("--mode", choices=sorted(bundle.MODES), default="public")
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    r = sub.add_parser("release")
    r.add_argument("gates", help="YAML or JSON")
    r.add_argument("bundles", nargs="+", metavar="TIER:SEED=FOLDER")
    for name in ("inspect", "validate"):
        sub.add_parser(name).add_argument("folder")
    sub.add_parser("list-recipes")
    a = p.parse_args(argv)
    if a.command == "list-recipes":
        print(*sorted(RECIPES), sep="\n")
        return 0
    spark = SparkSession.builder.appName("tallyrand").getOrCreate()
    if a.command == "generate":
        given = {k: json.loads(v) for k, _, v in (x.partition("=") for x in a.set)}
        print(json.dumps(generate(spark, a.recipe, seed=a.seed, **given).save(a.folder, mode=a.mode)["tables"]))
    elif a.command == "release":
        bundles: dict[str, dict[int, str]] = {}
        for name, _, folder in (x.partition("=") for x in a.bundles):
            tier, _, seed = name.partition(":")
            bundles.setdefault(tier, {})[int(seed)] = folder
        told, failed = release_report(spark, bundles, release.load_gates(bundle.read_text(spark, a.gates)))
        lines = [row.asDict() for row in failed.collect()]  # a row a gate
        print(json.dumps({"report": [row.asDict() for row in told.collect()], "failures": lines}, indent=1))
        return int(bool(lines))
    elif a.command == "inspect":
        print(json.dumps(bundle.read_json(spark, f"{a.folder}/manifest.json"), indent=1))
    else:
        errors = validate(spark, a.folder)
        print(*(errors or ["ok"]), sep="\n")
        return int(bool(errors))
    return 0


if __name__ == "__main__":
    sys.exit(main())
