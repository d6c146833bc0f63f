"""Preference mining over user-item review logs, written as Spark DataFrame functions."""
