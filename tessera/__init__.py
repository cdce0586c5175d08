"""tessera: a PySpark-native file catalog and block engine.

Typical use::

    from tessera import (VersionedStore, plan_rules, load_rules_json, build_blocks,
                         sync, get_datablock)

    rules = load_rules_json(spark, root + "/*/rule.json")   # or any rules DataFrame
    store = VersionedStore(spark, "hdfs:///catalog/store")
    status = sync(store, listing, rules)                      # listing: folder_path, name, size
    heads, rows, no_update = get_datablock(store, client_updated_at)
"""

from .operators.apply import (apply_file_changes, apply_folder_diffs, cascade_delete,
                              initial_snapshot, insert_if_absent)
from .operators.blocks import datablock, generate_rows, long_cells, merge_blocks, override_headers
from .operators.diff import change_summary, file_changes, folder_diff
from .operators.grouping import NameGrouping
from .operators.indexing import ranged_index
from .operators.stats import folder_stats, stat_drift, stats_refresh
from .plans.build import BlockBuild, build_blocks, incremental_blocks
from .plans.sync import gate_status, get_datablock, initial_load, sync
from .session import checkpoint_dir, local_session, materialize, scale_conf
from .sinks.files import csv_lines, json_dump, write_csv, write_invalid
from .sources.listing import (folders_with_file, glob_search, listed_names, listing_from_dir,
                              scan_files, scan_folders)
from .sources.rules import RulePlan, assign_rules, folder_rules, load_rules_json, plan_rules, rules_frame
from .sources.store import VersionedStore
from .streaming.requests import serve_sync_requests

__all__ = [name for name in dir() if not name.startswith("_")]
