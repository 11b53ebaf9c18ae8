"""Readers: folders of files, driver tables seen as assets, configuration, snapshots."""
