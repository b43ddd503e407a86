"""Oracle SQL fragments shared by several query modules (no side effects).

``UEBA_SQL`` continues the fixture's WITH clause with the behavioural
baseline written as plain SQL windows (row_number, a 1000-row frame, arg_max
for the first-seen mode); CTE ``s`` holds every event with its score.
"""

UEBA_SQL = """
, b AS (SELECT event_id, timestamp, coalesce(user_id, 'unknown') AS user_id, location, device,
              login_attempts, foreign_ip, CAST(hour(timestamp) AS INT) AS hour,
              CAST(coalesce(files_accessed, 0) AS BIGINT) AS files,
              CAST(coalesce(data_uploaded_mb, 0) AS BIGINT) AS upload,
              coalesce(location, 'Unknown') AS loc_key, coalesce(device, 'unknown') AS dev_key
       FROM security_logs),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS n FROM b),
m AS (SELECT *,
        row_number() OVER (PARTITION BY user_id, loc_key ORDER BY n) AS c_loc,
        min(n) OVER (PARTITION BY user_id, loc_key) AS fs_loc,
        row_number() OVER (PARTITION BY user_id, dev_key ORDER BY n) AS c_dev,
        min(n) OVER (PARTITION BY user_id, dev_key) AS fs_dev,
        avg(hour) OVER w AS avg_login_hour, avg(files) OVER w AS avg_files, avg(upload) OVER w AS avg_upload,
        sqrt(CAST(count(*) OVER w * sum(hour * hour) OVER w - sum(hour) OVER w * sum(hour) OVER w AS DOUBLE))
          / count(*) OVER w AS std_login_hour,
        sqrt(CAST(count(*) OVER w * sum(files * files) OVER w - sum(files) OVER w * sum(files) OVER w AS DOUBLE))
          / count(*) OVER w AS std_files
      FROM r WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)),
u AS (SELECT *,
        arg_max(loc_key, c_loc * 1000000000 - fs_loc) OVER wu AS usual_location,
        arg_max(dev_key, c_dev * 1000000000 - fs_dev) OVER wu AS usual_device
      FROM m WINDOW wu AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT *, n >= 10 AS hb,
        n >= 10 AND abs(hour - avg_login_hour) > 3 AS t_time,
        n >= 10 AND files > avg_files * 3 AS t_files,
        n >= 10 AND upload > avg_upload * 5 AS t_upload,
        n >= 10 AND location IS DISTINCT FROM usual_location AS t_loc,
        n >= 10 AND device IS DISTINCT FROM usual_device AS t_dev,
        n >= 10 AND coalesce(login_attempts, 1) > 3 AS t_logins,
        n >= 10 AND coalesce(foreign_ip, 0) = 1 AS t_foreign
      FROM u),
s AS (SELECT *,
        CAST((CASE WHEN t_time THEN 30 ELSE 0 END) + (CASE WHEN t_files THEN 50 ELSE 0 END)
           + (CASE WHEN t_upload THEN 25 ELSE 0 END) + (CASE WHEN t_loc THEN 20 ELSE 0 END)
           + (CASE WHEN t_dev THEN 15 ELSE 0 END) + (CASE WHEN t_logins THEN 20 ELSE 0 END)
           + (CASE WHEN t_foreign THEN 15 ELSE 0 END) AS INT) AS anomaly_score,
        CASE WHEN NOT hb THEN 'Learning phase - need 10+ events' ELSE concat_ws(' | ',
          CASE WHEN t_time THEN concat('⏰ Off-hours: ', CAST(hour AS STRING), 'h (usual: ',
               CAST(CAST(round_even(avg_login_hour, 0) AS BIGINT) AS STRING), 'h)') END,
          CASE WHEN t_files THEN concat('📁 High files: ', CAST(files AS STRING), ' (avg: ',
               CAST(CAST(round_even(avg_files, 0) AS BIGINT) AS STRING), ')') END,
          CASE WHEN t_upload THEN concat('📤 High upload: ', CAST(upload AS STRING), 'MB (avg: ',
               CAST(CAST(round_even(avg_upload, 0) AS BIGINT) AS STRING), 'MB)') END,
          CASE WHEN t_loc THEN concat('🌍 New location: ', coalesce(location, 'None'), ' (usual: ',
               usual_location, ')') END,
          CASE WHEN t_dev THEN concat('💻 New device: ', coalesce(device, 'None'), ' (usual: ',
               usual_device, ')') END,
          CASE WHEN t_logins THEN concat('🔑 Multiple logins: ', coalesce(CAST(login_attempts AS STRING), 'None')) END,
          CASE WHEN t_foreign THEN '🌐 Foreign IP detected' END) END AS reasons
      FROM t)
"""
