"""sparkfeat — Spark-native feature engineering and model evaluation.

Every operator takes and returns DataFrames. Fitted operators keep their
state in small DataFrames (one row per category, per column or per fold),
so transforms are plain joins / expressions and work on streams as well.
"""

from sparkfeat.session import checkpoint_dir, local_session

__all__ = ["checkpoint_dir", "local_session"]
