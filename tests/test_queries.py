"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from playtide.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or two of every family; the driver compares all of them.
CHECKED = """timeline_runs timeline_logical_plays timeline_weekly_weighted stats_summary stats_monthly_trend stats_listening_heatmap leaderboard_track_by_plays chart_rows_album
records_daily_binge_track records_longest_day_streak_artist records_no_repeat_streak records_fastest_milestone_track wrapped_monthly_leaders home_rediscovery chart_weekly_track chart_power_album
chart_year_end_artist chart_change_track record_same_rank_track record_longest_to_no1_album record_blocker_king_artist record_artist_simul cohort_symmetric_window cohort_return_within_30
returns_episodes search_bursts release_cycle_half_life import_signed_delta search_ranked_match search_inverted_index record_fingerprints stream_sessions stream_type_runs
entity_profile_track change_closure change_contribution_weeks cross_power_artist feed_no1_track feed_record_tied_album wrapped_album_completion wrapped_taste_drivers identity_components search_ngrams
published_weekly_tracks credits_artist_shares feat_lover_artist period_this_week records_comeback_track records_playback_milestones records_new_year records_skip_storm_album wrapped_listening_age wrapped_personality_label
change_import_plan change_range_covered record_artist_most_no1_album record_self_replacement_album record_decade_best_track platform_classes chart_power_track
chart_rows_track entity_ranks_album entity_rank_map_artist entity_top_share journey_milestones merge_recording_plan merge_composition_plan search_ranked_pages search_index_delta ledger_chart_album change_merge_chain review_year_comparison
ownership_project_chart import_staged review_diverse_records release_impact cross_power_album chart_honors feed_record_weeks_track record_triple_no1""".split()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else repr(float(v)) if isinstance(v, float) else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, small, duck, name):
    ours, theirs = QUERIES[name](spark, small).toPandas(), duck.execute(ORACLES[name]).df()
    pd.testing.assert_frame_equal(canonical(ours), canonical(theirs))


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
