"""Named queries over the test tables, each with its SQL twin where SQL can say the same."""

from . import checks, history, identity, market, merging, models, records, rescoring, runs, scalars, stored, texts  # noqa: F401
