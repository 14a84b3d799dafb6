"""Entry point for ``spark-submit run_job.py <job> <paths>``."""

from fathom.plans.jobs import main

if __name__ == "__main__":
    main()
