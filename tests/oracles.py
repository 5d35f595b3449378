"""Slow, plain restatements used only to check the engine."""

import math


def iou(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / max(union, 1e-7)


def coverage(d, g):
    w = max(0.0, min(d[2], g[2]) - max(d[0], g[0]))
    h = max(0.0, min(d[3], g[3]) - max(d[1], g[1]))
    own = (d[2] - d[0]) * (d[3] - d[1])
    return w * h / own if own > 0 else 0.0


def by_group(rows):
    groups = {}
    for row in rows:
        groups.setdefault((row["image_id"], row["label"]), []).append(row)
    return groups


def box_of(row):
    return row["x1"], row["y1"], row["x2"], row["y2"]


def greedy(dets, gts, threshold):
    """{(image, label, det_idx): 'tp' | 'ignored' | 'fp'}"""
    outcome = {}
    truths = by_group(gts)
    for key, group in by_group(dets).items():
        candidates = sorted(truths.get(key, []), key=lambda g: g["gt_idx"])
        used = set()
        order = sorted(group, key=lambda d: (math.isnan(d["score"]), -d["score"] if not math.isnan(d["score"]) else 0, d["det_idx"]))
        for d in order:
            best, best_iou = None, -1.0
            for g in candidates:
                if g["iscrowd"] or g["gt_idx"] in used:
                    continue
                value = iou(box_of(d), box_of(g))
                if value > best_iou:
                    best, best_iou = g, value
            if best is not None and best_iou >= threshold:
                used.add(best["gt_idx"])
                outcome[(*key, d["det_idx"])] = "tp"
            elif any(g["iscrowd"] and iou(box_of(d), box_of(g)) >= threshold for g in candidates):
                outcome[(*key, d["det_idx"])] = "ignored"
            else:
                outcome[(*key, d["det_idx"])] = "fp"
    return outcome


def protocol_match(dets, gts, threshold, area_range, overlap=None):
    """One lane of the published protocol: {(image, label, det_idx): (is_tp, is_ignored)}."""
    low, high = area_range
    truths = by_group(gts)
    outcome = {}
    for key, group in by_group(dets).items():
        rows = sorted(truths.get(key, []), key=lambda g: g["gt_idx"])
        flags = [(g, bool(g["iscrowd"]) or g["area"] < low or g["area"] > high) for g in rows]
        flags.sort(key=lambda p: p[1])
        matched = set()
        for d in sorted(group, key=lambda d: (-d["score"], d["det_idx"])):
            limit, chosen = min(threshold, 1 - 1e-10), -1
            for position, (g, ignored) in enumerate(flags):
                if position in matched and not g["iscrowd"]:
                    continue
                if chosen > -1 and not flags[chosen][1] and ignored:
                    break
                if overlap is None:
                    value = coverage(box_of(d), box_of(g)) if g["iscrowd"] else iou(box_of(d), box_of(g))
                else:
                    value = overlap(d, g)
                if value < limit:
                    continue
                limit, chosen = value, position
            area = (d["x2"] - d["x1"]) * (d["y2"] - d["y1"])
            if chosen == -1:
                outcome[(*key, d["det_idx"])] = (False, area < low or area > high)
            else:
                matched.add(chosen)
                outcome[(*key, d["det_idx"])] = (not flags[chosen][1], flags[chosen][1])
    return outcome


def average_precision(dets, gts, threshold, area_range, label, max_dets):
    """(precision at 101 recalls or None, final recall or None) of one class."""
    group_order = {}
    kept = []
    for key, group in by_group([d for d in dets if d["label"] == label]).items():
        ordered = sorted(group, key=lambda d: (-d["score"], d["det_idx"]))[:max_dets]
        kept += ordered
        for rank, d in enumerate(ordered):
            group_order[(*key, d["det_idx"])] = rank
    truths = [g for g in gts if g["label"] == label]
    outcome = protocol_match(kept, truths, threshold, area_range)
    low, high = area_range
    positives = sum(1 for g in truths if not g["iscrowd"] and low <= g["area"] <= high)
    if positives == 0:
        return None, None
    rows = sorted(kept, key=lambda d: (-d["score"], d["image_id"], group_order[(d["image_id"], d["label"], d["det_idx"])]))
    tp = fp = 0
    curve = []
    for d in rows:
        is_tp, is_ignored = outcome[(d["image_id"], d["label"], d["det_idx"])]
        if is_ignored:
            continue
        tp, fp = tp + is_tp, fp + (not is_tp)
        curve.append((tp / positives, tp / (tp + fp)))
    import numpy as np

    points = [max((p for r, p in curve if r >= level), default=0.0) for level in np.linspace(0, 1, 101)]
    return points, (curve[-1][0] if curve else 0.0)
