"""Schemas of the engine's tables."""

from __future__ import annotations

OBSERVATION = "stream_id string, cell string, ts long, value double, meta map<string,string>, context map<string,string>"
SOURCE = "stream_id string, class string, modality string, topic_tags array<string>, flavor string, config map<string,string>, status string, created_at long"
RAW = "stream_id string, cell string, ts long, value double, meta map<string,string>, scored boolean"
BIN = "stream_id string, cell string, scale int, bin_start long, n long, n_values long, vmin double, vmax double, vmean double, m2 double, sketch binary"
SURPRISE = "stream_id string, cell string, scale int, bin_start long, q_value double, presence_q double, precision double, n_obs long, tail_index double, model_version int, q_detect double"
EVIDENCE = "array<struct<stream_id:string,cell:string,bin_start:long,q:double,presence_q:double,extremity:double,s:double>>"
ALERT = f"alert_id long, opened_at long, status string, severity double, cell string, scale int, evidence {EVIDENCE}, stage int"
HEALTH = "component string, ts long, event string, detail string"
SEEN = "stream_id string, cell string, ts long, first_seen long"
CONTEXT = "stream_id string, cell string, ts long, rank double, size long, data map<string,string>"
CALIBRATION = "stream_id string, ts long, n long, span_days double, tv double, lo_ratio double, hi_ratio double, status string, verdict string"
USAGE = "component string, day long, bytes_in long, bytes_out long, requests long"
VERSION = 1
