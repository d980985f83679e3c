"""All registered queries of the engine and their DuckDB counterparts."""

from weftline.plans import controls, evaluation, flows, images, layout, matching, pages, recovery, relational, reports, tasks, texts  # noqa: F401
from weftline.plans.registry import ORACLES, QUERIES  # noqa: F401
