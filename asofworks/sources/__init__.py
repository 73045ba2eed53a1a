"""Files in and out: price panels, JSON lines, period views, registries and rosters (`files`), and their writers (`sinks`)."""
