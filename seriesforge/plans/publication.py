"""Search results to files: what a caller may see, in a wire format, under the caller's name."""

from pyspark.sql import DataFrame

from seriesforge.functions import policy
from seriesforge.operators.search import SeriesFilter, matching
from seriesforge.sources import exports
from seriesforge.sources.submissions import SENDERS


def sender_of(groups) -> tuple:
    """A submitter exports under its own institution, everyone else under the service's."""
    name = policy.persona(groups)
    country = name[len(policy.SUBMITTER):].upper() if name.startswith(policy.SUBMITTER) else None
    return SENDERS.get(country, exports.SENDER)


def publish(history: DataFrame, request: SeriesFilter, groups, wire_format: str, path: str, **options) -> exports.Export:
    """Export every row that matches; the page size of a search does not apply.

    An SDMX-ML message is read back before the call returns.
    """
    if wire_format == "sdmx-ml":
        options = {"sender": sender_of(groups), "validate": True, **options}
    return exports.export(matching(history, request, groups), wire_format, path, **options)
