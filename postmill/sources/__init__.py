"""Where rows come from and go to: provider pages, snapshots, derived tables."""
