"""DataFrame operators over broadcasts, calendars, runs and search results."""
