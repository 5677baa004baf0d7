"""Writers and document emitters."""
