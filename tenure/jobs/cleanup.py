"""The scheduled cleanup as one job, from the list of users to the purged tables.

The list is decided and written once, with all that later steps need to know of its users:
their trial, their last subscription, and the decision of the second check. Every other
output reads the written list, so none of them judges anew who is deleted, whatever has
happened to the tables since. Outputs are kept in a manifest (see ``Outputs``): a
job that was stopped goes on after its last whole output and ends in the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.functions import clock
from tenure.model import GRACE_DAYS, Tables
from tenure.plans import accounts, trials
from tenure.plans.access import Protected
from tenure.sources.manifest import Outputs

C = F.col

REPORT, RESULTS, HISTORY = "report", "results", "history"
LISTED, GONE, PURGED = "listed", "gone_keys", "purged"


class CleanupJob:
    """One run of the cleanup below ``root``.

    ``t`` are the tables when the run is scheduled, ``recheck`` those when the deletion
    starts. A restart takes the same arguments.
    """

    def __init__(
        self,
        spark: SparkSession,
        t: Tables,
        as_of: clock.Instant,
        protected: Protected,
        root: str,
        recheck: Tables | None = None,
        grace_days: int = GRACE_DAYS,
    ):
        self.t, self.as_of, self.protected = t, as_of, protected
        self.recheck, self.grace_days = recheck, grace_days
        self.outputs = Outputs(spark, root)

    def listed(self) -> DataFrame:
        """The candidates: user_id, email, trial dates, subscription_status and decision."""
        return self.outputs.once(
            LISTED,
            lambda: trials.deletion_list(
                self.t, self.as_of, self.protected, self.grace_days, self.recheck
            ),
        )

    def doomed(self) -> DataFrame:
        return self.listed().filter(C("decision") == "delete")

    def report(self) -> DataFrame:
        return self.outputs.once(REPORT, lambda: trials.deletion_run_report(self.listed()))

    def results(self) -> DataFrame:
        """Per deleted user, whether the external directory has an account to delete."""
        return self.outputs.once(
            RESULTS, lambda: trials.deletion_results(self.listed(), self.t.external_directory)
        )

    def next_history(self) -> DataFrame:
        """The deletion history with the list's users, not yet written."""
        source = self.doomed().select(
            "user_id",
            "email",
            F.lit(accounts.DEFAULT_DELETION_REASON).alias("reason"),
            "trial_start_date",
            "trial_end_date",
            "trial_status",
            "subscription_status",
        )
        return accounts.record_deletions(self.t.deleted_account_history, source, self.as_of)

    def history(self) -> DataFrame:
        return self.outputs.once(HISTORY, self.next_history)

    def gone_keys(self) -> DataFrame:
        """The owners whose rows go: deleted users, and their customers."""
        return self.outputs.once(GONE, lambda: trials.owner_keys(self.t, self.doomed()))

    def purge_report(self) -> DataFrame:
        return trials.purge_counts(self.t, self.gone_keys())

    def purged(self) -> Tables:
        """The next tables without the deleted users, each written once."""
        keys = self.gone_keys()
        after = {
            name: self.outputs.once(
                f"{PURGED}-{name}", lambda name=name: trials.without_owners(self.t, name, keys)
            )
            for name in trials.PURGED_TABLES
        }
        return self.t.replace(**after, deleted_account_history=self.history())

    def run(self) -> Tables:
        """All outputs in their order; users are on record before their rows go."""
        self.listed()
        self.results()
        self.history()
        self.report()
        return self.purged()
