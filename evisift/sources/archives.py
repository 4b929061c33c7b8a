"""Archive members unpacked once into plain, splittable files."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from evisift.session import checkpoint_dir
from evisift.sources.blocks import member_lines


def unpack_lines(spark: SparkSession, path: str, *, member: str | None = None, suffix: str = "") -> str:
    """Write a member as text files under the checkpoint folder and return their path."""
    target = os.path.join(checkpoint_dir(spark), f"unpacked-{uuid.uuid4().hex}")
    member_lines(spark, path, member=member, suffix=suffix).select("value").write.text(target)
    return target
