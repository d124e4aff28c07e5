"""One object with a method per question, over kept tables and a price book."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from .operators import control, panels, upserts
from .operators.pricing import layered_prices, price_index
from .operators.scans import Filter, daily_rollups
from .operators.upserts import Store
from .store import Snapshot, SnapshotStore


@dataclass(frozen=True)
class Engine:
    """``store`` holds the facts, ``prices`` the rows of read_prices() of all layers. Every answer is a lazy DataFrame.

    An engine over a SnapshotStore (``over``) answers from the version it was opened on, whatever is written meanwhile.
    """

    spark: SparkSession
    store: Store
    prices: DataFrame
    rollups: DataFrame | None = None
    kept: SnapshotStore | None = None
    snapshot: Snapshot | None = None

    @classmethod
    def over(cls, spark: SparkSession, kept: SnapshotStore, prices: DataFrame, snapshot: Snapshot | None = None) -> Engine:
        """An engine on the newest version of kept tables, or on one that is given."""
        at = snapshot or kept.open()
        return cls(spark, at.store(), prices, at.read("rollups"), kept, at)

    def refreshed(self) -> Engine:
        """The engine on the newest version."""
        return self if self.kept is None else Engine.over(self.spark, self.kept, self.prices)

    def _facts(self, f: Filter) -> DataFrame:
        """Buckets for a window: of kept tables, its days alone."""
        return self.store.buckets if self.snapshot is None else self.snapshot.days("buckets", f.start, f.end)

    def _days(self, f: Filter) -> DataFrame | None:
        return self.rollups if self.snapshot is None else self.snapshot.days("rollups", f.start, f.end)

    @property
    def index(self) -> DataFrame:
        return price_index(layered_prices(self.prices))

    def with_rollups(self) -> Engine:
        return replace(self, rollups=daily_rollups(self.store.buckets))

    def ingest(self, uploads: DataFrame) -> tuple[Engine, DataFrame]:
        """The engine after the uploads, and the response to them. Over kept tables this writes one new version; else it is lazy, for tables that fit a test."""
        if self.kept is not None:
            at, answer = self.kept.ingest(uploads)
            return Engine.over(self.spark, self.kept, self.prices, at), answer
        after = upserts.ingest(self.store, uploads)
        rollups = None if self.rollups is None else upserts.refreshed_rollups(self.rollups, after.buckets, upserts.new_buckets(uploads))
        return replace(self, store=after, rollups=rollups), upserts.response(self.store.buckets, uploads)

    def summary(self, f: Filter) -> DataFrame:
        return panels.summary(self._facts(f), self._days(f), self.index, f)

    def session_totals(self, f: Filter) -> DataFrame:
        return panels.session_totals(self.store.sessions, f)

    def series(self, f: Filter) -> DataFrame:
        return panels.series(self.spark, self._facts(f), self._days(f), self.index, f)

    def breakdown(self, f: Filter, by: str = "source") -> DataFrame:
        return panels.breakdown(self._facts(f), self._days(f), self.index, f, by)

    def distributions(self, f: Filter) -> DataFrame:
        return panels.distributions(self._facts(f), self._days(f), self.index, f)

    def activity(self, f: Filter) -> DataFrame:
        return panels.activity(self.spark, self._facts(f), f)

    def sessions(self, f: Filter, limit: int = panels.USUAL_SESSIONS) -> DataFrame:
        return panels.latest_sessions(self.store.sessions, f, limit)

    def filters(self, hide_projects: bool = False) -> DataFrame:
        return panels.filter_options(self.store.buckets, hide_projects)

    def hosts(self) -> DataFrame:
        return control.hosts_by_last_seen(self.store.hosts)

    def without_host(self, host_id: str, tokens: DataFrame) -> tuple[Engine, DataFrame]:
        """The engine and the tokens without a host. Refused (ValueError) for accounts, unknown hosts, and hosts with a token in force."""
        state = control.deletable(self.store.hosts, tokens, host_id)
        if state != "ok":
            raise ValueError(f"host {host_id}: {state}")
        left = control.without_host({"hosts": self.store.hosts, "buckets": self.store.buckets, "sessions": self.store.sessions, "tokens": tokens}, host_id)
        rollups = None if self.rollups is None else control.without_host({"r": self.rollups}, host_id)["r"]
        if self.kept is not None:
            self.kept.replace(hosts=left["hosts"], buckets=left["buckets"], sessions=left["sessions"], rollups=rollups)
            return self.refreshed(), left["tokens"]
        store = replace(self.store, hosts=left["hosts"], buckets=left["buckets"], sessions=left["sessions"])
        return replace(self, store=store, rollups=rollups), left["tokens"]

    def accounts(self, now: dt.datetime) -> DataFrame:
        return control.listed_accounts(self.store.accounts, now)

    def with_archived(self, account_hash: str, at: dt.datetime | None) -> Engine:
        """The engine with an account archived or, without a time, restored."""
        accounts = control.set_archived(self.store.accounts, account_hash, at)
        if self.kept is not None:
            self.kept.replace(accounts=accounts)
            return self.refreshed()
        return replace(self, store=replace(self.store, accounts=accounts))

    def with_prices(self, rows: DataFrame) -> Engine:
        """The engine with one more layer of prices (imported_prices())."""
        return replace(self, prices=self.prices.unionByName(rows))

    def price_list(self) -> DataFrame:
        return layered_prices(self.prices)
