"""DuckDB texts of the stages, written from the definitions, for the oracle only."""

W = "PARTITION BY SK_ID_CURR ORDER BY DAYS_INSTALMENT, NUM_INSTALMENT_NUMBER, NUM_INSTALMENT_VERSION, SK_ID_PREV"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

ORACLE_VIEWS: dict[str, str] = {
    "ov_application": """
SELECT * REPLACE (CASE WHEN DAYS_EMPLOYED = 365243 THEN NULL ELSE DAYS_EMPLOYED END AS DAYS_EMPLOYED),
 CAST(DAYS_EMPLOYED = 365243 AS INT) AS DAYS_EMPLOYED_ANOMALY_FLAG,
 round_even(-DAYS_BIRTH / 365.25E0, 2) AS AGE_YEARS,
 round_even(-(CASE WHEN DAYS_EMPLOYED = 365243 THEN NULL ELSE DAYS_EMPLOYED END) / 365.25E0, 2) AS EMPLOYMENT_YEARS,
 AMT_CREDIT / nullif(AMT_INCOME_TOTAL, 0) AS CREDIT_TO_INCOME_RATIO,
 AMT_ANNUITY / nullif(AMT_INCOME_TOTAL, 0) AS ANNUITY_TO_INCOME_RATIO,
 AMT_GOODS_PRICE / nullif(AMT_CREDIT, 0) AS GOODS_TO_CREDIT_RATIO
FROM fx_application""",
    "ov_payments": """
SELECT *, DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT AS payment_delay_days,
 CAST(DAYS_ENTRY_PAYMENT IS NULL OR AMT_PAYMENT IS NULL OR AMT_PAYMENT <= 0 AS INT) AS missing_payment_flag,
 CAST(coalesce(AMT_PAYMENT, 0) > 0 AND coalesce(AMT_PAYMENT, 0) + 1E-9 < coalesce(AMT_INSTALMENT, 0) AS INT) AS partial_payment_flag,
 CAST(coalesce(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT, 0) > 0 AS INT) AS late_payment_flag
FROM fx_installments""",
    "ov_events": """
SELECT *, first_payment_day - DAYS_INSTALMENT AS aggregated_payment_delay_days,
 CAST(total_amount_paid + 1E-9 < coalesce(AMT_INSTALMENT, 0) AS INT) AS underpaid_after_aggregation_flag
FROM (SELECT SK_ID_PREV, SK_ID_CURR, NUM_INSTALMENT_VERSION, NUM_INSTALMENT_NUMBER,
  min(DAYS_INSTALMENT) AS DAYS_INSTALMENT, min(DAYS_ENTRY_PAYMENT) AS first_payment_day, max(DAYS_ENTRY_PAYMENT) AS last_payment_day,
  max(AMT_INSTALMENT) AS AMT_INSTALMENT, coalesce(sum(AMT_PAYMENT), 0E0) AS total_amount_paid, count(*) AS row_count,
  max(missing_payment_flag) AS missing_payment_flag, max(partial_payment_flag) AS partial_payment_flag,
  max(late_payment_flag) AS late_payment_flag, max(payment_delay_days) AS max_payment_delay_days
 FROM ov_payments GROUP BY 1, 2, 3, 4) e""",
    "ov_snap": f"""
SELECT concat(SK_ID_CURR, '_', borrower_event_order) AS snapshot_id, *,
 CAST(next_DAYS_INSTALMENT IS NOT NULL AS INT) AS has_next_installment, next_DAYS_INSTALMENT - snapshot_day AS next_installment_gap_days
FROM (SELECT CAST(row_number() OVER w - 1 AS INT) AS borrower_event_order, DAYS_INSTALMENT AS snapshot_day,
  CAST(floor(DAYS_INSTALMENT / 30E0) AS INT) AS snapshot_month_approx,
  SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_VERSION, NUM_INSTALMENT_NUMBER, DAYS_INSTALMENT, first_payment_day, AMT_INSTALMENT,
  total_amount_paid, missing_payment_flag, underpaid_after_aggregation_flag, aggregated_payment_delay_days,
  lead(SK_ID_PREV) OVER w AS next_SK_ID_PREV, lead(NUM_INSTALMENT_VERSION) OVER w AS next_NUM_INSTALMENT_VERSION,
  lead(NUM_INSTALMENT_NUMBER) OVER w AS next_NUM_INSTALMENT_NUMBER, lead(DAYS_INSTALMENT) OVER w AS next_DAYS_INSTALMENT,
  lead(first_payment_day) OVER w AS next_first_payment_day, lead(AMT_INSTALMENT) OVER w AS next_AMT_INSTALMENT,
  lead(total_amount_paid) OVER w AS next_total_amount_paid, lead(missing_payment_flag) OVER w AS next_missing_payment_flag,
  lead(underpaid_after_aggregation_flag) OVER w AS next_underpaid_after_aggregation_flag,
  lead(aggregated_payment_delay_days) OVER w AS next_aggregated_payment_delay_days
 FROM ov_events WINDOW w AS ({W})) s""",
    "ov_missed": """
SELECT snapshot_id, SK_ID_CURR, SK_ID_PREV, borrower_event_order, snapshot_day, snapshot_month_approx, DAYS_INSTALMENT, first_payment_day,
 aggregated_payment_delay_days, missing_payment_flag, underpaid_after_aggregation_flag, next_SK_ID_PREV, next_NUM_INSTALMENT_NUMBER,
 next_DAYS_INSTALMENT, next_first_payment_day, next_aggregated_payment_delay_days, next_missing_payment_flag,
 next_underpaid_after_aggregation_flag, next_installment_gap_days,
 CAST(coalesce(next_missing_payment_flag, 0) > 0 OR coalesce(next_underpaid_after_aggregation_flag, 0) > 0
  OR coalesce(next_aggregated_payment_delay_days, -999999) > 0 AS INT) AS missed_upcoming_emi,
 1 AS target_available_flag, 'missed_upcoming_emi' AS target_name
FROM ov_snap WHERE next_DAYS_INSTALMENT IS NOT NULL""",
    "ov_inst_days": """
SELECT DISTINCT SK_ID_CURR, DAYS_INSTALMENT AS day FROM ov_events WHERE coalesce(aggregated_payment_delay_days, -999999) >= 30""",
    "ov_pos_days": """
SELECT DISTINCT SK_ID_CURR, MONTHS_BALANCE * 30 AS day FROM fx_pos WHERE coalesce(SK_DPD, 0) >= 30 OR coalesce(SK_DPD_DEF, 0) >= 30""",
    "ov_hits": """
SELECT s.snapshot_id, s.SK_ID_CURR, s.SK_ID_PREV, s.borrower_event_order, s.snapshot_day, s.snapshot_month_approx,
 m.mx AS borrower_max_installment_day, CAST(m.mx >= s.snapshot_day + 90 AS INT) AS future_window_complete_flag,
 CAST(EXISTS (SELECT 1 FROM ov_inst_days d WHERE d.SK_ID_CURR = s.SK_ID_CURR AND d.day > s.snapshot_day AND d.day <= s.snapshot_day + 90) AS INT) AS future_inst_dpd30_hit,
 CAST(EXISTS (SELECT 1 FROM ov_pos_days d WHERE d.SK_ID_CURR = s.SK_ID_CURR AND d.day > s.snapshot_day AND d.day <= s.snapshot_day + 90) AS INT) AS future_pos_dpd30_hit
FROM ov_snap s JOIN (SELECT SK_ID_CURR, max(DAYS_INSTALMENT) AS mx FROM ov_events GROUP BY 1) m ON m.SK_ID_CURR = s.SK_ID_CURR""",
    "ov_dpd30": """
SELECT *, greatest(future_inst_dpd30_hit, future_pos_dpd30_hit) AS future_dpd30, 1 AS target_available_flag, 'future_dpd30' AS target_name
FROM ov_hits WHERE future_window_complete_flag = 1""",
    "ov_behaviour": f"""
SELECT *, CAST(is_late = 0 AND is_missed = 0 AS INT) AS is_on_time,
 row_number() OVER ({W}) AS rn
FROM (SELECT *, CAST(coalesce(aggregated_payment_delay_days, -999999) > 0 AS INT) AS is_late, CAST(missing_payment_flag > 0 AS INT) AS is_missed,
  CAST(underpaid_after_aggregation_flag > 0 AS INT) AS is_partial, total_amount_paid / nullif(AMT_INSTALMENT, 0) AS payment_ratio,
  coalesce(aggregated_payment_delay_days, 0) AS delay_nonnull FROM ov_events) b""",
    "ov_hist": f"""
SELECT concat(SK_ID_CURR, '_', rn - 1) AS snapshot_id, SK_ID_CURR, SK_ID_PREV, CAST(rn - 1 AS INT) AS borrower_event_order,
 DAYS_INSTALMENT AS snapshot_day, CAST(floor(DAYS_INSTALMENT / 30E0) AS INT) AS snapshot_month_approx,
 CAST(rn - 1 AS INT) AS hist_total_installments,
 CAST(coalesce(sum(is_late) OVER b, 0) AS INT) AS hist_late_count, CAST(coalesce(sum(is_missed) OVER b, 0) AS INT) AS hist_missed_count,
 CAST(coalesce(sum(is_partial) OVER b, 0) AS INT) AS hist_partial_count, CAST(coalesce(sum(is_on_time) OVER b, 0) AS INT) AS hist_on_time_count,
 CAST(sum(delay_nonnull) OVER b AS DOUBLE) / nullif(rn - 1, 0) AS hist_delay_mean, CAST(max(delay_nonnull) OVER b AS DOUBLE) AS hist_delay_max,
 CAST(lag(aggregated_payment_delay_days) OVER w AS DOUBLE) AS hist_recent_delay, lag(payment_ratio) OVER w AS hist_recent_payment_ratio,
 CAST(coalesce(sum(delay_nonnull) OVER l3, 0) AS DOUBLE) / 3E0 AS hist_delay_mean_last_3,
 CAST(coalesce(sum(delay_nonnull) OVER l6, 0) AS DOUBLE) / 6E0 AS hist_delay_mean_last_6,
 CAST(coalesce(sum(is_late) OVER l3, 0) AS DOUBLE) AS hist_late_count_last_3, CAST(coalesce(sum(is_late) OVER l6, 0) AS DOUBLE) AS hist_late_count_last_6,
 CAST(rn - 1 - coalesce(max(CASE WHEN is_on_time = 0 THEN rn END) OVER b, 0) AS INT) AS hist_on_time_streak,
 CAST(rn - 1 - coalesce(max(CASE WHEN is_late = 0 THEN rn END) OVER b, 0) AS INT) AS hist_late_streak
FROM ov_behaviour WINDOW w AS ({W}), b AS ({W} {BEFORE}),
 l3 AS ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), l6 AS ({W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""",
    "ov_app_features": """
SELECT SK_ID_CURR, AMT_INCOME_TOTAL, AMT_CREDIT, AMT_ANNUITY, AMT_GOODS_PRICE, AGE_YEARS, EMPLOYMENT_YEARS, DAYS_EMPLOYED_ANOMALY_FLAG,
 CREDIT_TO_INCOME_RATIO, ANNUITY_TO_INCOME_RATIO, GOODS_TO_CREDIT_RATIO, EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3,
 coalesce(CODE_GENDER, 'missing') AS CODE_GENDER, coalesce(NAME_INCOME_TYPE, 'missing') AS NAME_INCOME_TYPE,
 coalesce(NAME_EDUCATION_TYPE, 'missing') AS NAME_EDUCATION_TYPE, coalesce(NAME_FAMILY_STATUS, 'missing') AS NAME_FAMILY_STATUS,
 coalesce(NAME_HOUSING_TYPE, 'missing') AS NAME_HOUSING_TYPE, coalesce(OCCUPATION_TYPE, 'missing') AS OCCUPATION_TYPE
FROM ov_application""",
    "ov_previous": """
SELECT *, CASE WHEN NAME_CONTRACT_STATUS IS NULL THEN 'missing' WHEN NAME_CONTRACT_STATUS = 'Approved' THEN 'approved'
 WHEN NAME_CONTRACT_STATUS = 'Refused' THEN 'rejected' WHEN NAME_CONTRACT_STATUS = 'Active' THEN 'active'
 WHEN NAME_CONTRACT_STATUS = 'Unused offer' THEN 'unused_offer' WHEN NAME_CONTRACT_STATUS = 'Canceled' THEN 'canceled' ELSE 'other' END AS status_group
FROM fx_previous""",
    "ov_prev_features": """
SELECT *, prev_approved_count / nullif(prev_application_count, 0) AS prev_approval_rate
FROM (SELECT SK_ID_CURR, count(SK_ID_PREV) AS prev_application_count, sum(CAST(status_group = 'approved' AS INT))::BIGINT AS prev_approved_count,
 sum(CAST(status_group = 'rejected' AS INT))::BIGINT AS prev_rejected_count, sum(CAST(status_group = 'active' AS INT))::BIGINT AS prev_active_count,
 avg(AMT_CREDIT) AS prev_credit_mean, max(AMT_CREDIT) AS prev_credit_max, avg(AMT_ANNUITY) AS prev_annuity_mean,
 avg(AMT_DOWN_PAYMENT) AS prev_down_payment_mean, max(DAYS_DECISION) AS prev_days_decision_max, min(DAYS_DECISION) AS prev_days_decision_min
FROM ov_previous GROUP BY 1) p""",
    "ov_balance": """
SELECT *, CASE STATUS WHEN '0' THEN 'current' WHEN '1' THEN 'dpd_1_30' WHEN '2' THEN 'dpd_31_60' WHEN '3' THEN 'dpd_61_90' WHEN '4' THEN 'dpd_91_120'
 WHEN '5' THEN 'dpd_120_plus' WHEN 'C' THEN 'closed' WHEN 'X' THEN 'unknown_or_no_loan' ELSE 'other' END AS status_group
FROM fx_bureau_balance""",
    "ov_bb": """
SELECT SK_ID_BUREAU, count(MONTHS_BALANCE) AS bb_record_count, max(CAST(coalesce(STATUS IN ('1','2','3','4','5'), false) AS INT)) AS bb_any_dpd,
 max(CAST(coalesce(STATUS IN ('2','3','4','5'), false) AS INT)) AS bb_any_dpd30,
 sum(CAST(coalesce(STATUS IN ('1','2','3','4','5'), false) AS INT))::BIGINT AS bb_dpd_month_count
FROM ov_balance GROUP BY 1""",
    "ov_bureau_features": """
SELECT b.SK_ID_CURR, count(b.SK_ID_BUREAU) AS bureau_record_count, sum(CAST(CREDIT_ACTIVE = 'Active' AS INT))::BIGINT AS bureau_active_count,
 sum(CAST(CREDIT_DAY_OVERDUE > 0 AS INT))::BIGINT AS bureau_overdue_count, avg(AMT_CREDIT_SUM) AS bureau_credit_sum_mean,
 avg(AMT_CREDIT_SUM_DEBT) AS bureau_credit_sum_debt_mean, avg(AMT_CREDIT_MAX_OVERDUE) AS bureau_max_overdue_mean,
 max(DAYS_CREDIT) AS bureau_days_credit_max, min(DAYS_CREDIT) AS bureau_days_credit_min, max(bb_any_dpd) AS bureau_bb_any_dpd,
 max(bb_any_dpd30) AS bureau_bb_any_dpd30, coalesce(sum(bb_dpd_month_count), 0)::BIGINT AS bureau_bb_dpd_month_count
FROM fx_bureau b LEFT JOIN ov_bb ON b.SK_ID_BUREAU = ov_bb.SK_ID_BUREAU GROUP BY 1""",
    "ov_base": """
SELECT h.*, a.* EXCLUDE (SK_ID_CURR), p.* EXCLUDE (SK_ID_CURR), b.* EXCLUDE (SK_ID_CURR)
FROM ov_hist h LEFT JOIN ov_app_features a ON h.SK_ID_CURR = a.SK_ID_CURR
 LEFT JOIN ov_prev_features p ON h.SK_ID_CURR = p.SK_ID_CURR LEFT JOIN ov_bureau_features b ON h.SK_ID_CURR = b.SK_ID_CURR""",
    "ov_model": """
SELECT f.*, m.missed_upcoming_emi, d.future_dpd30
FROM ov_base f LEFT JOIN ov_missed m ON f.snapshot_id = m.snapshot_id LEFT JOIN ov_dpd30 d ON f.snapshot_id = d.snapshot_id""",
    "ov_days": "SELECT DISTINCT snapshot_day FROM ov_missed",
    "ov_split": """
SELECT snapshot_day, CASE WHEN i <= t THEN 'train' WHEN i <= least(greatest(floor(n * (0.70E0 + 0.15E0)), t + 1), n - 1) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, least(greatest(floor(n * 0.70E0), 1), n - 2) AS t
 FROM (SELECT snapshot_day, row_number() OVER (ORDER BY snapshot_day) AS i, CAST(count(*) OVER () AS DOUBLE) AS n FROM ov_days) a) b""",
    "ov_missed_split": """
SELECT m.snapshot_id, m.SK_ID_CURR, m.snapshot_day, m.missed_upcoming_emi AS label, s.split FROM ov_missed m JOIN ov_split s ON m.snapshot_day = s.snapshot_day""",
    "ov_pred": """
SELECT p.*, s.split FROM fx_pred p JOIN ov_split s ON p.snapshot_day = s.snapshot_day""",
    "ov_points": """
SELECT target, model, split, y_prob AS score, sum(label)::BIGINT AS tp, (count(*) - sum(label))::BIGINT AS fp FROM ov_pred GROUP BY 1, 2, 3, 4""",
    "ov_curve": """
SELECT *, cum_tp / (cum_tp + cum_fp) AS "precision", cum_tp / nullif(positives, 0) AS recall
FROM (SELECT *, (sum(tp) OVER w)::BIGINT AS cum_tp, (sum(fp) OVER w)::BIGINT AS cum_fp, (sum(tp) OVER g)::BIGINT AS positives, (sum(fp) OVER g)::BIGINT AS negatives
 FROM ov_points WINDOW w AS (PARTITION BY target, model, split ORDER BY score DESC), g AS (PARTITION BY target, model, split)) c""",
    "ov_areas": """
SELECT target, model, split, sum(fp * (cum_tp - tp / 2E0)) / nullif(CAST(max(positives) AS DOUBLE) * max(negatives), 0) AS roc_auc,
 sum(tp * "precision") / nullif(max(positives), 0) AS pr_auc FROM ov_curve GROUP BY 1, 2, 3""",
    "ov_best": """
SELECT target, model, split, score AS optimal_threshold, f1 AS best_f1
FROM (SELECT *, row_number() OVER (PARTITION BY target, model, split ORDER BY f1 DESC, score) AS r
 FROM (SELECT *, 2E0 * "precision" * recall / ("precision" + recall + 1E-12) AS f1 FROM ov_curve) f) x WHERE r = 1""",
    "ov_metrics": """
SELECT a.target, a.model, a.split, n_samples, positive_rate, roc_auc, pr_auc, f1, "precision", recall, balanced_accuracy FROM ov_areas a JOIN (
 SELECT target, model, split, count(*) AS n_samples, avg(label) AS positive_rate,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2E0 AS balanced_accuracy
 FROM (SELECT *, sum(CAST(y_pred_05 = 1 AND label = 1 AS INT)) OVER g AS tp, sum(CAST(y_pred_05 = 1 AND label = 0 AS INT)) OVER g AS fp,
   sum(CAST(y_pred_05 = 0 AND label = 1 AS INT)) OVER g AS fn, sum(CAST(y_pred_05 = 0 AND label = 0 AS INT)) OVER g AS tn
  FROM ov_pred WINDOW g AS (PARTITION BY target, model, split)) q GROUP BY target, model, split, tp, fp, fn, tn) m
 ON a.target = m.target AND a.model = m.model AND a.split = m.split""",
    "ov_test": "SELECT * FROM ov_pred WHERE split = 'test'",
    "ov_long": """
SELECT target, model, unnest(['CODE_GENDER', 'NAME_INCOME_TYPE', 'NAME_EDUCATION_TYPE', 'NAME_FAMILY_STATUS', 'NAME_HOUSING_TYPE', 'OCCUPATION_TYPE']) AS slice_col,
 unnest([CODE_GENDER, NAME_INCOME_TYPE, NAME_EDUCATION_TYPE, NAME_FAMILY_STATUS, NAME_HOUSING_TYPE, OCCUPATION_TYPE]) AS slice_val,
 label, y_prob, y_pred_optimal AS pred FROM fx_pred""",
    "ov_cells": """
SELECT target, model, slice_col, slice_val, count(*) AS n, sum(label)::BIGINT AS pos, sum(pred)::BIGINT AS pred_pos,
 sum(pred * label)::BIGINT AS tp, sum(pred * (1 - label))::BIGINT AS fp, sum((1 - pred) * label)::BIGINT AS fn, sum((1 - pred) * (1 - label))::BIGINT AS tn,
 avg(y_prob) AS mean_prob, avg((y_prob - label) * (y_prob - label)) AS brier FROM ov_long WHERE slice_val IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "ov_all": """
SELECT target, model, count(*) AS n, sum(label)::BIGINT AS pos, sum(y_pred_optimal)::BIGINT AS pred_pos, sum(y_pred_optimal * label)::BIGINT AS tp,
 sum(y_pred_optimal * (1 - label))::BIGINT AS fp, sum((1 - y_pred_optimal) * label)::BIGINT AS fn, sum((1 - y_pred_optimal) * (1 - label))::BIGINT AS tn
FROM fx_pred GROUP BY 1, 2""",
    "ov_slice_areas": """
SELECT target, model, slice_col, slice_val, sum(fp * (cum_tp - tp / 2E0)) / nullif(CAST(max(p) AS DOUBLE) * max(n), 0) AS roc_auc,
 sum(tp * (cum_tp / (cum_tp + cum_fp))) / nullif(max(p), 0) AS pr_auc
FROM (SELECT *, sum(tp) OVER w AS cum_tp, sum(fp) OVER w AS cum_fp, sum(tp) OVER g AS p, sum(fp) OVER g AS n
 FROM (SELECT target, model, slice_col, slice_val, y_prob, sum(label) AS tp, sum(1 - label) AS fp FROM ov_long WHERE slice_val IS NOT NULL GROUP BY 1, 2, 3, 4, 5) s
 WINDOW w AS (PARTITION BY target, model, slice_col, slice_val ORDER BY y_prob DESC), g AS (PARTITION BY target, model, slice_col, slice_val)) c GROUP BY 1, 2, 3, 4""",
    "ov_slices": """
SELECT c.target, c.model, c.slice_col, c.slice_val, n, pos / n AS positive_rate, roc_auc, pr_auc, brier
FROM ov_cells c JOIN ov_slice_areas a ON c.target = a.target AND c.model = a.model AND c.slice_col = a.slice_col AND c.slice_val = a.slice_val
WHERE n >= 100 AND pos >= 10 AND pos < n""",
    "ov_groups": """
SELECT c.target, c.model, c.slice_col, c.slice_val AS "group", n, pos AS n_actual_pos, pred_pos AS n_predicted_pos, pred_pos / n AS positive_pred_rate, roc_auc, pr_auc,
 coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp / nullif(pred_pos, 0) AS "precision", tp / nullif(pos, 0) AS recall, tp / nullif(pos, 0) AS tpr,
 fp / nullif(n - pos, 0) AS fpr, fn / nullif(pos, 0) AS fnr, CASE WHEN pos > 0 THEN brier END AS brier
FROM ov_cells c JOIN ov_slice_areas a ON c.target = a.target AND c.model = a.model AND c.slice_col = a.slice_col AND c.slice_val = a.slice_val
WHERE n >= 500 AND c.slice_col <> 'OCCUPATION_TYPE'""",
    "ov_fairness": """
SELECT g.*, positive_pred_rate / nullif(o.pred_pos / o.n, 0) AS disparate_impact_ratio, tpr - o.tp / nullif(o.pos, 0) AS tpr_gap_vs_overall,
 fpr - o.fp / nullif(o.n - o.pos, 0) AS fpr_gap_vs_overall FROM ov_groups g JOIN ov_all o ON g.target = o.target AND g.model = o.model""",
    "ov_harm": """
SELECT target, model, slice_col, slice_val AS "group", n, n - pos AS n_actual_neg, pos AS n_actual_pos, fp, fn, fp / nullif(n - pos, 0) AS fp_rate_exclusion_harm,
 fn / nullif(pos, 0) AS fn_rate_institutional_harm FROM ov_cells WHERE n >= 500 AND slice_col <> 'OCCUPATION_TYPE'""",
    "ov_calfair": """
SELECT target, model, slice_col, slice_val AS "group", n, pos / n AS prevalence, mean_prob AS mean_predicted_prob, brier AS brier_score, mean_prob - pos / n AS calibration_gap
FROM ov_cells WHERE n >= 500 AND pos > 0 AND slice_col <> 'OCCUPATION_TYPE'""",
    # Scores of three parts, their mean and a pooled model, on the same rows.
    "ov_fed": """
SELECT target, model, label, federation, client, y_prob FROM (
 SELECT *, unnest(['centralized', 'federated', 'local', 'local', 'local']) AS federation, unnest(['all', 'all', 'client_1', 'client_2', 'client_3']) AS client,
  unnest([pooled, (s1 + s2 + s3) / 3E0, s1, s2, s3]) AS y_prob
 FROM (SELECT target, model, label, y_prob AS pooled, ((SK_ID_CURR * (k + 1) + ord * 7) % 53 + 30 * label) / 100E0 AS s1,
   ((SK_ID_CURR * (k + 2) + ord * 7) % 53 + 30 * label) / 100E0 AS s2, ((SK_ID_CURR * (k + 3) + ord * 7) % 53 + 30 * label) / 100E0 AS s3
  FROM (SELECT *, CASE WHEN model = 'rf' THEN 13 ELSE 23 END AS k FROM fx_pred) a) b) c""",
    "ov_comparison": """
SELECT target, model, federation, client, threshold, n, pos / n AS positive_rate, roc_auc, pr_auc, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
 coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2E0 AS balanced_accuracy
FROM (SELECT c.target, c.model, federation, client, t.optimal_threshold AS threshold, sum(tp + fp)::BIGINT AS n, max(p)::BIGINT AS pos,
 sum(fp * (cum_tp - tp / 2E0)) / nullif(CAST(max(p) AS DOUBLE) * max(q), 0) AS roc_auc, sum(tp * (cum_tp / (cum_tp + cum_fp))) / nullif(max(p), 0) AS pr_auc,
 coalesce(sum(tp) FILTER (y_prob >= t.optimal_threshold), 0)::BIGINT AS tp, coalesce(sum(fp) FILTER (y_prob >= t.optimal_threshold), 0)::BIGINT AS fp,
 coalesce(sum(tp) FILTER (y_prob < t.optimal_threshold), 0)::BIGINT AS fn, coalesce(sum(fp) FILTER (y_prob < t.optimal_threshold), 0)::BIGINT AS tn
FROM (SELECT *, sum(tp) OVER w AS cum_tp, sum(fp) OVER w AS cum_fp, sum(tp) OVER g AS p, sum(fp) OVER g AS q
 FROM (SELECT target, model, federation, client, y_prob, sum(label) AS tp, sum(1 - label) AS fp FROM ov_fed GROUP BY 1, 2, 3, 4, 5) s
 WINDOW w AS (PARTITION BY target, model, federation, client ORDER BY y_prob DESC), g AS (PARTITION BY target, model, federation, client)) c
 JOIN fx_threshold t ON c.target = t.target AND c.model = t.model GROUP BY 1, 2, 3, 4, 5) z""",
}
