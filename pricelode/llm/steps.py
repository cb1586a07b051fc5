"""Steps of long jobs: written tables whose shuffle files go as soon as the table is there."""

from __future__ import annotations

from pricelode.plans.durable import checkpointed, freeing

__all__ = ["freeing", "written"]

#: A frame as a table in the shared folder, which cuts its lineage; the shuffles that made it are freed.
written = checkpointed
