"""Spark-native analytics for labelled text spans."""

from spanlytics.session import build_session, materialize, shared_folder, ship_package

__all__ = ["build_session", "materialize", "shared_folder", "ship_package"]
